import hashlib
import importlib
import random
import re
import time

from genolith.llm import secrets

BASE = (
    ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute(text):
    text = text or ""
    found = [(m.start(), r, kind, m.end()) for r, (kind, rx, ok) in enumerate(BASE) for m in rx.finditer(text) if ok(m)]
    table, at, k = secrets.train(secrets.labelled_samples()), {c: i for i, c in enumerate(secrets.ALPHABET)}, len(secrets.ALPHABET)
    base = {(s, e) for s, _, _, e in found}
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{20,}", text):
        s = m[0]
        score = sum(float(f"{table[at[a] * k + at[b]]:.4f}") for a, b in zip(s, s[1:]))
        if score >= max(secrets.MIN_TOTAL, secrets.MIN_MEAN * (len(s) - 1)) and (m.start(), m.end()) not in base:
            found.append((m.start(), 3, "markov", m.end()))
    return sorted(found)


TEXTS = [
    None, "", "token", "password: token: abcdefghij", 'API_KEY = "abcdef"', "secret=12345", "é" * 3 + "Token='aZ09+/x_.=-' tail",
    "AKIA" + "B" * 16 + " AKIA" + "C" * 15, "deadbeef" * 4 + " " + "0" * 23, "x" + hashlib.sha256(b"a").hexdigest() + "y" + "\n" + "token=" + hashlib.sha256(b"b").hexdigest(),
    "the key Zq8vT1xW9rK3mB7nC5yD2 stands alone", "understandingTheInternationalOrganization", "😀 passwd:abcdef😀 secret :  'abcdefgh'", "token=token=abcdefgh", "a" * 50_000 + " AKIA" + "Q7" * 9,
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, found string")
    rows = secrets.find_secrets(df).select("doc_id", "found").collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert [(x.s, x.kind, x.e) for x in r.found] == [(s, k, e) for s, _, k, e in brute(TEXTS[r.doc_id])], TEXTS[r.doc_id]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_long_and_dense_texts_take_seconds(spark):
    r = random.Random(3)
    run = "".join(r.choices(secrets.ALPHABET, k=1_000_000))
    dense = "é ".join(hashlib.sha256(str(i).encode()).hexdigest()[: 24 + i % 30] for i in range(20_000))
    df = spark.createDataFrame([(1, run), (2, dense)], "doc_id long, text string").repartition(2)
    start = time.time()
    found = {x.doc_id: x for x in secrets.find_secrets(df).collect()}
    clean = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert time.time() - start < 60
    assert [(x.s, x.kind, x.e) for x in found[1].found] == [(s, k, e) for s, _, k, e in brute(run)]
    assert [(x.s, x.kind, x.e) for x in found[2].found] == [(s, k, e) for s, _, k, e in brute(dense)]
    assert clean[2] == "é ".join(["[hex]"] * 20_000)


def test_precision_and_recall_on_labelled_documents(spark):
    """Keys of a kind that no base pattern knows, planted into clean documents of the test data; what else is found is checked too."""
    r = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    before = {x.doc_id: {(y.s, y.e) for y in x.found} for x in secrets.find_secrets(spark.createDataFrame(docs)).collect()}
    rows, planted = [], {}
    for x in docs[:300]:
        key = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=r.randrange(24, 48)))
        name = "_".join(r.choices(secrets.IDENTIFIER_WORDS, k=4))
        rows.append((x.doc_id, f"{x.text} {name} {key}"))
        planted[x.doc_id] = (len(x.text) + 2 + len(name), len(x.text) + 2 + len(name) + len(key))
    hit = wrong = 0
    for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        new = {(y.s, y.e) for y in x.found if y.kind == "markov"} - before[x.doc_id]
        hit += planted[x.doc_id] in new
        wrong += len(new - {planted[x.doc_id]})
    assert hit >= 0.97 * len(rows) and wrong <= 0.02 * len(rows)


def test_models_separate_held_out_samples():
    table, at, k = secrets.train(secrets.labelled_samples(1000)), {c: i for i, c in enumerate(secrets.ALPHABET)}, len(secrets.ALPHABET)
    held = [(s, y) for s, y in secrets.labelled_samples(1500)[6000:] if len(s) >= secrets.MIN_LENGTH]
    right = sum((sum(table[at[a] * k + at[b]] for a, b in zip(s, s[1:])) >= max(secrets.MIN_TOTAL, secrets.MIN_MEAN * (len(s) - 1))) == y for s, y in held)
    assert right / len(held) > 0.95


def test_redaction(spark):
    key = "deadbeef" * 4
    df = spark.createDataFrame([(1, "a token=abcdefgh b", 18, "x"), (2, "clean", 5, "x"), (3, None, 0, "x"), (4, f"é token={key} 😀 {key}", 0, "x")], "doc_id long, text string, n_chars long, found string")
    rows = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert {r.found for r in rows.values()} == {"x"}
    assert rows[4].text == "é [assign] 😀 [hex]"
    assert rows[1].text == "a [assign] b" and rows[1].n_chars == 12
    assert rows[2].text == "clean" and rows[3].text is None


def hashes(n):
    return " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))


def test_time_follows_the_hits(spark):
    """One text of 100,000 hits takes about as long as two of 50,000, in spans and in redaction."""

    def took(function, *sizes):
        df = spark.createDataFrame([(i, hashes(n)) for i, n in enumerate(sizes)], "doc_id long, text string").coalesce(1)
        began = time.time()
        function(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for function in (secrets.find_secrets, secrets.redact):
        took(function, 10)
        assert took(function, 100_000) < 2 * took(function, 50_000, 50_000) + 2


def test_strings_of_other_origin(spark):
    """Keys from a random generator, in alphabets of their own, and names of this machine's standard library."""
    r = random.Random(12)
    keys = ["".join(r.choice(a) for _ in range(n)) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789_-") for n in (24, 32, 40) for _ in range(60)]
    names = set()
    for module in ("os", "socket", "ssl", "unittest.mock", "asyncio", "logging", "http", "http.client", "email", "email.message", "xml.dom.minidom", "argparse", "subprocess", "multiprocessing", "tarfile", "zipfile", "ipaddress", "decimal", "typing", "inspect"):
        m = importlib.import_module(module)
        names |= {f"{module}.{a}" for a in dir(m)} | set(dir(m)) | {f"{a}.{b}" for a in dir(m) if isinstance(getattr(m, a), type) for b in dir(getattr(m, a))}
    names = sorted(n for n in names if len(n) >= 20)
    df = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(keys + names)], "doc_id long, text string")
    found = {x.doc_id for x in secrets.find_secrets(df).where("size(found) > 0").collect()}
    recall = sum(i in found for i in range(len(keys))) / len(keys)
    alarms = sum(i in found for i in range(len(keys), len(keys) + len(names))) / len(names)
    print("recall", recall, "names reported", alarms, len(names))
    assert len(names) > 1000 and recall > 0.9 and alarms < 0.1
