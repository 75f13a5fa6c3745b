import random
import re

import pytest

from genolith.sources import readers


def folder_of(tmp_path, r):
    records = {}
    for name, n, width in (("chr1.fa", 2500, 60), ("chr2.fasta", 333, 7), ("sub/III.fas", 2000, 2000), ("empty.fa", 0, 60)):
        seq = list("".join(r.choice("ACGTacgt") for _ in range(n)))
        for _ in range(n // 150):
            at = r.randrange(n)
            k = r.choice([1, 3, 49, 50, 51, 200])
            seq[at : at + k] = "N" * len(seq[at : at + k])
        seq = "".join(seq)[:n]
        lines = [seq[i : i + width] for i in range(0, n, width)]
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        ends = r.choice(["\n", "\r\n"])
        path.write_text("nothing yet\n" * (name == "chr2.fasta") + f">first one{ends}" + "".join(x + ends for x in lines) + f">second{ends}TTTTTTTTTTTTTTTT{ends}>third\nA\n", newline="")
        records[path.stem] = seq.upper()
    return records


def regions(seq, bridge, least, truncate):
    spans = []
    for m in re.finditer("[ACGT-]+", seq):
        if spans and m.start() - spans[-1][1] < bridge:
            spans[-1][1] = m.end()
        else:
            spans.append([m.start(), m.end()])
    out = []
    for a, b in spans:
        if b - a >= least:
            n = max((b - a) // truncate, 1)
            out += [(a + i * truncate + 1, b if i == n - 1 else a + (i + 1) * truncate) for i in range(n)]
    return out


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_first_records_whatever_the_split(spark, tmp_path, split):
    records = folder_of(tmp_path, random.Random(split))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        genome = readers.genome_fasta(spark, str(tmp_path), size=64)
        got = {}
        for x in genome.store.blocks.join(genome.names, "align_id").collect():
            got.setdefault(x.chr_name, {})[x.block] = x.rows[0][1:]
        assert {c: "".join(b[k] for k in sorted(b)) for c, b in got.items()} == {c: s for c, s in records.items() if s}
        assert all(len(b[k]) == 64 for b in got.values() for k in sorted(b)[:-1])
        for bridge, least, truncate in ((50, 100, 300), (1, 10, 64), (300, 500, 10_000)):
            found = {}
            for x in readers.valid_regions(genome, bridge, least, truncate).collect():
                assert x.seq == records[x.chr_name][x.start - 1 : x.end]
                found.setdefault(x.chr_name, []).append((x.start, x.end))
            assert {c: sorted(v) for c, v in found.items()} == {c: v for c, s in records.items() if (v := regions(s, bridge, least, truncate))}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
