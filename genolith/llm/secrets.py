"""Secrets in texts: three base patterns, and two character Markov models held against each other.

A candidate is a run of at least ``min_length`` characters that a key could be written in. Its
log-likelihood ratio under a first-order Markov model of random strings and one of ordinary
identifiers, both trained from labelled samples, decides. Everything runs as DataFrame
expressions: positions come from running sums of the lengths of the pieces between matches, scores from a
constant array of transition log-ratios. Work is in proportion to the text and, nearly, to its hits.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import read

# The base patterns of the contract, in the order in which kinds are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs are maximal, so a least length in the pattern finds what a test of each match afterwards would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
MIN_LENGTH = 20
#: Total and mean log-likelihood ratio that a candidate must reach.
MIN_TOTAL, MIN_MEAN = 12.0, 0.75

#: Words that identifiers are made of in the built-in labelled sample.
IDENTIFIER_WORDS = """
account action address after all amount analysis and answer array background balance before between block board body
border branch buffer build business button cache call change channel character check child class client close cluster
code collection column command company component connection container content context control controller convert count
country create current custom data database date default delete describe description detail device different directory
display document domain driver element employee enable engine entity entry environment error event example exception
execution expected export factory field file filter find first float folder following format forward frame function
general generate government group handler header height history host identifier image important index information input
instance integer interface internal item kernel key label language last layer layout length level library limit line
list listener load local location login machine main manager manifest mapping master matrix member memory message method
middle minimum mode model module monitor month mother name national network next node notification number object offset
operation option order organization original output owner package page parameter parent parser password path pattern
people percent permission person picture pixel player pointer policy position power president previous process processor
product profile program project property protocol provider public query question queue random range reader record
reference region register relation remote render repository request resource response result return right role route
runtime sample schedule schema scheme school screen script search secondary section security select sequence serial
server service session setting shadow should simple single size source space special standard start state statement
static status storage strategy stream string structure student style subject submit success summary support switch
symbol system table target task template test text that their there these thing thread through time timeout together
token tool topic tracker transaction transfer transform translation type understand unique university update upload
user utility validator value variable vector version view visible widget width window without word worker world would
writer avec beaucoup chose comme dans depuis elle encore entre famille grande heure homme jamais jour maison monde
notre nouveau parce pendant petit plus pour premier quelque rien sans temps toujours travail trois votre aber alles
andere arbeit auch bei bitte dann deutsch diese durch einer eines entwicklung frage ganz gegen geschichte gesellschaft
haben heute immer jahr kinder leben machen mehr mensch nicht nichts noch oder schule sehr seine sich sprache stadt und
unter viel welt wenn werden wieder wissen zeit zwischen ahora algo antes aqui bien cada casa como cuando desde donde
entonces entre esta este forma gente gobierno hacer hasta hombre hoy lugar manera mejor menos mientras mismo momento
mucho mujer mundo nada noche nombre nosotros nuevo otro padre parte pero persona poco porque primera puede siempre
sobre tambien tiempo todo trabajo vida
""".split()


def labelled_samples(per_kind: int = 1500) -> list[tuple[str, bool]]:
    """(string, is random), made by rule: digests in three spellings, and joined words in five styles."""
    out, n = [], len(IDENTIFIER_WORDS)
    for i in range(per_kind):
        digest = hashlib.sha256(str(i).encode()).digest()
        out += [(digest.hex()[: 24 + i % 40], True), (base64.b64encode(digest).decode()[: 20 + i % 24], True), (base64.b32encode(digest).decode().rstrip("=")[: 20 + i % 20], True)]
        picked = [IDENTIFIER_WORDS[digest[j] * 251 % n] if j % 2 else IDENTIFIER_WORDS[(digest[j] * 257 + digest[j + 1]) % n] for j in range(2 + i % 4)]
        style = i % 5
        joined = {0: "_".join(picked), 1: picked[0] + "".join(w.title() for w in picked[1:]), 2: "-".join(picked), 3: "/".join(picked) + ".html", 4: "".join(picked)}[style]
        out += [(joined, False), (("_".join(picked)).upper() if i % 3 == 0 else ".".join(picked), False), (f"{picked[0]}.{picked[1]}_{1900 + i % 200}", False)]
    return out


def train(samples: Iterable[tuple[str, bool]], smoothing: float = 0.5) -> list[float]:
    """Row-major table of log P(b | a, random) - log P(b | a, ordinary) over ALPHABET; other characters end a run."""
    k, at = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [[smoothing] * k for _ in range(k)], False: [[smoothing] * k for _ in range(k)]}
    for text, random in samples:
        for a, b in zip(text, text[1:]):
            if a in at and b in at:
                counts[random][at[a]][at[b]] += 1
    table = []
    for r, o in zip(counts[True], counts[False]):
        rs, os_ = sum(r), sum(o)
        table += [math.log(x / rs) - math.log(y / os_) for x, y in zip(r, o)]
    return table


#: Elements that one step of a running value handles by itself.
_STEP = 256


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each element of an array of longs what ``combine`` makes of ``start`` and all before it. Steps of _STEP elements, so that no long array is copied for each element."""
    zero = F.lit(start).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / _STEP).cast("int")), lambda b: F.slice(values, b * _STEP + 1, _STEP))
    total = lambda first, xs: F.aggregate(xs, first, combine)
    nothing = F.array().cast("array<struct<at:bigint,x:array<bigint>>>")
    placed = F.aggregate(
        blocks,
        F.struct(zero.alias("at"), nothing.alias("out")),
        lambda acc, x: F.struct(total(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x.alias("x")))).alias("out")),
        lambda acc: acc["out"],
    )
    inside = lambda p: F.aggregate(
        p["x"],
        F.struct(p["at"].alias("at"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    return F.flatten(F.transform(placed, inside))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _lengths(pairs: Column, length: Callable[[Column], Column]) -> Column:
    return F.transform(pairs, lambda x: (length(x["p"]) + length(x["m"])).cast("long"))


def _with_spans(df: DataFrame, name: str, pattern: str, keep: Callable[[Column], Column], when: str) -> DataFrame:
    """df and ``name``: array of (s, e, bs, be), ranges in code points and in bytes of the leftmost non-overlapping matches in _sx_t that ``keep`` takes."""
    quoted = "r'" + pattern.replace("'", r"\x27") + "'"
    t = F.when(F.expr(when), F.col("_sx_t")).otherwise(F.lit(""))  # a text that cannot match is not searched
    df = df.withColumn("_sx_s", t).withColumn("_sx_m", F.expr(f"regexp_extract_all(_sx_s, {quoted}, 0)")).withColumn("_sx_p", F.expr(f"split(_sx_s, {quoted}, -1)"))
    # pieces and matches take turns: a match starts where its piece and all before it end
    for at, length in (("_sx_c", F.char_length), ("_sx_o", F.octet_length)):
        steps = _lengths(F.arrays_zip(F.slice("_sx_p", 1, F.size("_sx_m")).alias("p"), F.col("_sx_m").alias("m")), length)
        df = df.withColumn(f"{at}l", F.when(F.size("_sx_m") > 0, steps).otherwise(F.array().cast("array<bigint>")))
        df = df.withColumn(at, running(F.col(f"{at}l"), _plus))
    zipped = F.filter(F.arrays_zip(F.col("_sx_m").alias("m"), F.col("_sx_c").alias("c"), F.col("_sx_cl").alias("cl"), F.col("_sx_o").alias("o"), F.col("_sx_ol").alias("ol")), lambda x: keep(x["m"]))
    end = lambda x, a, l: x[a] + x[l]
    span = lambda x: F.struct(
        (end(x, "c", "cl") - F.char_length(x["m"])).cast("int").alias("s"), end(x, "c", "cl").cast("int").alias("e"), (end(x, "o", "ol") - F.octet_length(x["m"])).cast("int").alias("bs"), end(x, "o", "ol").cast("int").alias("be")
    )
    return df.withColumn(name, F.transform(zipped, span)).drop("_sx_s", "_sx_m", "_sx_p", "_sx_c", "_sx_cl", "_sx_o", "_sx_ol")


def _likely(table: list[float], min_length: int, total: float, mean: float) -> Callable[[Column], Column]:
    """Whether a candidate's log-likelihood ratio reaches ``total``, and ``mean`` a transition. Its characters are cut out once."""
    ratios = F.expr("CAST(split('" + ",".join(f"{x:.4f}" for x in table) + "', ',') AS array<float>)")
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1

    def keep(m: Column) -> Column:
        n = F.char_length(m)
        step = lambda codes: lambda a, i: a + F.get(ratios, F.get(codes, i - 1) * len(ALPHABET) + F.get(codes, i))
        score = lambda codes: F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), step(codes))
        each = F.transform(F.array(F.transform(F.split(m, ""), lambda c: F.expr("0") + code(c))), score)
        return (n >= min_length) & (F.get(each, F.lit(0)) >= F.greatest(F.lit(total), mean * (n - 1)))

    return keep


def _ranked(rank: int, kind: str) -> Column:
    return F.transform(f"_sx_{kind}", lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["bs"].alias("bs"), x["be"].alias("be")))


def find_secrets(docs: DataFrame, table: list[float] | None = None, min_length: int = MIN_LENGTH, total: float = MIN_TOTAL, mean: float = MIN_MEAN, name: str = "found") -> DataFrame:
    """The input with ``name``: array of (kind, s, e, bs, be), by start and then kind as listed in KINDS; bs and be are in bytes.

    A null text holds nothing. Spans of different kinds may overlap; a Markov span that is the same as a base span is not reported
    twice. Rows are independent: repeats and keys of any kind are kept. Other columns stay, but for one called ``name`` or
    starting with ``_sx_``, which is replaced.
    """
    table = table or train(labelled_samples())
    symbols = "A-Za-z0-9+/_.=-"
    every = lambda m: F.lit(True)
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    hits = {
        "assign": (ASSIGN, long_enough, r"rlike(_sx_t, r'(?i)passw|secret|token|api_?key')"),
        "access": (ACCESS, every, "contains(_sx_t, 'AKIA')"),
        "hex": (HEX, every, r"rlike(_sx_t, r'[0-9a-f]{24}')"),
        "markov": (rf"(?<![{symbols}])[{symbols}]{{{min_length},}}+", _likely(table, min_length, total, mean), rf"rlike(_sx_t, r'[{symbols}]{{{min_length}}}')"),
    }
    df = docs.withColumn("_sx_t", F.coalesce("text", F.lit("")))
    for kind, (pattern, keep, when) in hits.items():
        df = _with_spans(df, f"_sx_{kind}", pattern, keep, when)
    # a Markov span comes after the base spans of its limits in one sorted array, so that it is held against the one before it only
    tagged = lambda spans, own: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(own).alias("own"), x["bs"].alias("bs"), x["be"].alias("be")))
    df = df.withColumn("_sx_all", F.array_sort(F.concat(tagged(F.concat("_sx_assign", "_sx_access", "_sx_hex"), False), tagged(F.col("_sx_markov"), True))))
    before = F.concat(F.array(F.lit(None)), F.slice("_sx_all", 1, F.greatest(F.size("_sx_all") - 1, F.lit(0))))
    alone = lambda x: x["x"]["own"] & (x["b"].isNull() | (x["b"]["s"] != x["x"]["s"]) | (x["b"]["e"] != x["x"]["e"]))
    df = df.withColumn("_sx_two", F.arrays_zip(F.col("_sx_all").alias("x"), before.alias("b")))
    df = df.withColumn("_sx_markov", F.transform(F.filter("_sx_two", alone), lambda x: F.struct(*[x["x"][c].alias(c) for c in ("s", "e", "bs", "be")]))).drop("_sx_all", "_sx_two")
    ranked = [_ranked(rank, kind) for rank, kind in enumerate(KINDS)]
    found = F.transform(F.array_sort(F.concat(*ranked)), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["bs"].alias("bs"), x["be"].alias("be")))
    return df.withColumn(name, found).drop("_sx_t", *[f"_sx_{k}" for k in KINDS])


def redact(docs: DataFrame, **options) -> DataFrame:
    """Each found span of a text replaced by [kind]; overlapping spans count as one, named by the first. n_chars, if there, follows; all other columns, whatever
    they are called (but for names that start with _rd_ or _sx_), stay as they are, and so do rows without a secret."""
    columns = docs.columns
    df = find_secrets(docs, name="_rd_f", **options)
    # a run of overlapping spans starts where a span starts at or beyond all ends before it, and ends at the last of these
    df = df.withColumn("_rd_e", F.transform("_rd_f", lambda x: x["be"].cast("long"))).withColumn("_rd_r", running(F.col("_rd_e"), _greater))
    df = df.withColumn("_rd_n", F.filter(F.arrays_zip(F.col("_rd_f").alias("f"), F.col("_rd_r").alias("r")), lambda x: x["f"]["bs"] >= x["r"]))
    ends = F.concat(F.transform(F.slice("_rd_n", 2, F.greatest(F.size("_rd_n") - 1, F.lit(0))), lambda x: x["r"]), F.array(F.array_max("_rd_e")))
    df = df.withColumn("_rd_z", F.arrays_zip(F.col("_rd_n").alias("n"), ends.alias("to")))
    cut = lambda b, a, z: F.substring(b, a + 1, z - a).cast("string")
    tail = lambda b: lambda x, i: F.concat(F.lit("["), x["n"]["f"]["kind"], F.lit("]"), cut(b, x["to"].cast("int"), F.coalesce(F.get("_rd_z", i + 1)["n"]["f"]["bs"], F.octet_length(b)).cast("int")))
    whole = lambda b: F.concat(cut(b, F.lit(0), F.get("_rd_z", F.lit(0))["n"]["f"]["bs"]), F.array_join(F.transform("_rd_z", tail(b)), ""))
    # the bytes go through a lambda, so that they are not copied out of the row for each piece
    pieces = F.get(F.transform(F.array(F.col("text").cast("binary")), whole), F.lit(0))
    some = F.size("_rd_f") > 0
    df = df.withColumn("text", F.when(some, pieces).otherwise(F.col("text")))
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(some, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(*columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text of documents."""
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    joined = "array_join(transform({a}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    base = joined.format(a="filter(found, x -> x.kind <> 'markov')")
    counts = [f"CAST(size(filter(found, x -> x.kind = '{k}')) AS bigint) AS n_{k}" for k in KINDS[:3]]
    return found.selectExpr("doc_id", *counts, f"sha2({base}, 256) AS base_sha256", f"{joined.format(a='found')} AS spans")
