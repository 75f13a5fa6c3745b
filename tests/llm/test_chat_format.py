import hashlib

from genolith.llm import chat_format as cf
from genolith.llm.common import Scratch


def test_round_trip(spark):
    rows = [(1, 0, "user", cf.TEST_TEXT, "x"), (1, 1, "assistant", cf.TEST_TEXT, "x"), (1, 2, None, None, "x"), (1, 2, None, None, "x"), (2, 5, "a:b#<\\", "é#😀<\\", "x"), (2, None, "assistant", "", "x"), (None, 0, "assistant", "null id", "x"), (3, 0, "user", "long " * 50_000, "x")]
    rows += [(4, t, "assistant" if t % 2 else "user", f"turn {t} \\# {'é' * (t % 7)}", "x") for t in range(1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    segments = Scratch(spark, "t").keep(cf.format_conversations(df), "s")
    got = {r.conv_id: r for r in cf.summarize(segments).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        loss = "".join(text for _, role, text in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})
    assert segments.where("conv_id = 4").count() == 4
    assert cf.summarize(cf.format_conversations(df.limit(0))).count() == 0


def test_large_runs_are_cut_into_parts(spark):
    rows = [(1, 0, "user", f"{i:04d} " + "x" * 3000) for i in range(3000)] + [(2, 0, "user", "after")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    segments = Scratch(spark, "t").keep(cf.format_conversations(df, part_bytes=1 << 20), "s")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert segments.where("conv_id = 1").count() > 1
    got = {r.conv_id: r for r in cf.summarize(segments).collect()}
    want = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in sorted(rows[:-1])).encode()).hexdigest()
    assert got[1].turns_sha256 == want and got[1].n_turns == 3000 and got[2].n_turns == 1
