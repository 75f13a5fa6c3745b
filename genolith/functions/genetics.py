
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

import numpy as np

GAP = ord("-")
BASES = np.zeros(256, bool)
BASES[[ord(c) for c in "ACGT"]] = True
GC = np.zeros(256, bool)
GC[[ord("G"), ord("C")]] = True


def matrix(seqs: Sequence[str]) -> np.ndarray:
    """Rows of bytes, upper case; an error if lengths differ."""
    if len({len(s) for s in seqs}) > 1:
        raise ValueError("sequences of an alignment differ in length")
    return np.array([np.frombuffer(s.upper().encode(), np.uint8) for s in seqs]).reshape(len(seqs), -1)


def gc_ratio(seq: np.ndarray) -> float | None:
    n = int(BASES[seq].sum())
    return int(GC[seq].sum()) / n if n else None


def column_stats(m: np.ndarray) -> dict:
    """length, comparables, identities, differences, gaps, ns, error, pi; null pi without comparable columns."""
    gap, base = m == GAP, BASES[m]
    has_gap = gap.any(0)
    comparable = base.all(0)
    differs = comparable & (m != m[0]).any(0)
    n = int(comparable.sum())
    pairs = [(m[i, comparable] != m[j, comparable]).sum() / n for i, j in combinations(range(len(m)), 2)] if n else []
    return {"length": m.shape[1], "comparables": n, "identities": n - int(differs.sum()), "differences": int(differs.sum()), "gaps": int(has_gap.sum()), "ns": int((~has_gap & ~comparable).sum()), "error": int(gap.all(0).sum()), "pi": float(np.mean(pairs)) if pairs else None}


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """1-based inclusive runs of true values."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [(int(a) + 1, int(b)) for a, b in zip(edges[::2], edges[1::2])]


def call_indels(m: np.ndarray, outgroup: np.ndarray | None = None) -> list[dict]:
    """Indels of the ingroup rows: runs of columns in which some row has a gap; polarised where the outgroup decides."""
    out, spans = [], runs((m == GAP).any(0))
    for i, (a, b) in enumerate(spans):
        rows = ["".join(map(chr, r[a - 1 : b])) for r in m]
        alleles = list(dict.fromkeys(rows))
        own = None if outgroup is None else "".join(map(chr, outgroup[a - 1 : b]))
        full = next((r for r in rows if "-" not in r), max(rows, key=lambda r: len(r) - r.count("-")))
        kind, occured, freq = "C", "unknown", -1
        if len(alleles) == 2 and any(set(x) == {"-"} for x in alleles):
            ancestral = rows[0] if own is None else own if own in alleles else None
            if ancestral is not None:
                bits = [int(r != ancestral) for r in rows]
                derived = next(x for x in alleles if x != ancestral)
                kind, occured, freq = ("D" if set(derived) == {"-"} else "I"), "".join(map(str, bits)), sum(bits)
                freq = min(freq, len(rows) - freq) if own is None else freq
        left = a - 1 - (spans[i - 1][1] if i else 0)
        right = (spans[i + 1][0] if i + 1 < len(spans) else m.shape[1] + 1) - b - 1
        out.append({"start": a, "end": b, "length": b - a + 1, "seq": full.replace("-", ""), "all_seqs": "|".join(rows), "outgroup_seq": own, "left_extand": left, "right_extand": right, "gc": gc_ratio(np.frombuffer(full.encode(), np.uint8)), "freq": freq, "occured": occured, "type": kind})
    return out


def call_snps(m: np.ndarray, outgroup: np.ndarray | None = None) -> list[dict]:
    """Comparable columns with two bases or more."""
    out = []
    for at in np.flatnonzero(BASES[m].all(0) & (m != m[0]).any(0)):
        column = [chr(x) for x in m[:, at]]
        own = None if outgroup is None else chr(outgroup[at])
        alleles = list(dict.fromkeys(column))
        ancestral = column[0] if own is None else own if own in alleles else None
        occured, freq, mutant = "unknown", -1, "Complex"
        if len(alleles) == 2 and ancestral is not None:
            bits = [int(c != ancestral) for c in column]
            freq = sum(bits) if own is not None else min(sum(bits), len(bits) - sum(bits))
            occured, mutant = "".join(map(str, bits)), f"{ancestral}->{next(c for c in alleles if c != ancestral)}"
        query = next((c for c in column[1:] if c != column[0]), column[1])
        out.append({"pos": int(at) + 1, "target_base": column[0], "query_base": query, "all_bases": "".join(column), "outgroup_base": own, "mutant_to": mutant, "freq": freq, "occured": occured})
    return out


def segment_stats(seq: np.ndarray, size: int, step: int) -> tuple[float | None, ...]:
    """gc mean, sample std, cv and mean absolute difference of neighbours, of sub-windows of bases; null where too few."""
    gcs = [x for x in (gc_ratio(seq[i : i + size]) for i in range(0, len(seq) - size + 1, step)) if x is not None]
    if not gcs:
        return None, None, None, None
    mean = float(np.mean(gcs))
    if len(gcs) < 2:
        return mean, None, None, None
    std, around = float(np.std(gcs, ddof=1)), mean if mean <= 0.5 else 1 - mean
    return mean, std, std / around if around else None, float(np.mean(np.abs(np.diff(gcs))))


def gc_wave(seq: np.ndarray, size: int, step: int, vicinal: int, fall: float) -> list[dict]:
    """Sliding windows over comparable bases with gc and the flag T (trough), C (crest) or null; flags alternate.

    A window is a trough (crest) if its gc is the least (most) within ``vicinal`` bases on both sides, with a
    rise (fall) of ``fall`` or more on both.
    """
    starts = list(range(0, len(seq) - size + 1, step))
    gcs = [gc_ratio(seq[s : s + size]) for s in starts]
    around = max(1, vicinal // step)
    flags: list[str | None] = [None] * len(gcs)
    for i, g in enumerate(gcs):
        before, after = ([x for x in side if x is not None] for side in (gcs[max(0, i - around) : i], gcs[i + 1 : i + 1 + around]))
        if g is None or not before or not after:
            continue
        if g <= min(before + after) and max(before) - g >= fall and max(after) - g >= fall:
            flags[i] = "T"
        elif g >= max(before + after) and g - min(before) >= fall and g - min(after) >= fall:
            flags[i] = "C"
    last = None
    for i, f in enumerate(flags):
        if f is None:
            continue
        if last is not None and flags[last] == f:  # of two in a row the more extreme one stays
            better = gcs[i] < gcs[last] if f == "T" else gcs[i] > gcs[last]
            flags[last if better else i] = None
            last = i if better else last
        else:
            last = i
    return [{"start": s + 1, "end": s + size, "gc": g, "flag": f} for s, g, f in zip(starts, gcs, flags)]


def interval_windows(start: int, end: int, size: int = 100) -> list[dict]:
    """Windows of an interval between indels: one S at -1 if under two windows long, else L and R from both ends inward; the rest goes to the innermost L."""
    length = end - start + 1
    if length <= 0:
        return []
    m = length // size
    if m < 2:
        return [{"start": start, "end": end, "type": "S", "distance": -1, "density": m - 1}]
    left, right = (m + 1) // 2, m // 2
    out = [{"start": start + size * k, "end": start + size * k + size - 1, "type": "L", "distance": k, "density": m - 1} for k in range(left)]
    out[-1]["end"] += length - m * size
    return out + [{"start": end - size * k - size + 1, "end": end - size * k, "type": "R", "distance": k, "density": m - 1} for k in range(right)]


def feature_windows(start: int, end: int, low: int, high: int, style: str, size: int = 100, most: int = 20) -> list[dict]:
    """Windows around and in a feature (start..end) of a block (low..high).

    Outside: L before it and R after it, distances 1, 2, ... Inside: from both edges, -1, -2, ...; inside_2 from -90 on
    for the parts beyond. center: from the middle outward, 0 at the middle; center_intact keeps the feature whole as 0.
    """
    out = []
    add = lambda a, b, t, d: out.append({"start": a, "end": b, "type": t, "distance": d}) if a >= low and b <= high else None
    middle = (start + end) // 2
    if style in ("edge", "edge_only"):
        for k in range(most):
            add(start - size * (k + 1), start - size * k - 1, "L", k + 1)
            add(end + size * k + 1, end + size * (k + 1), "R", k + 1)
        inner = min(most, (end - start + 1) // (2 * size))
        for k in range(inner):
            add(start + size * k, start + size * (k + 1) - 1, "L", -(k + 1))
            add(end - size * (k + 1) + 1, end - size * k, "R", -(k + 1))
        if style == "edge":
            for k in range(inner):
                add(middle - size * (k + 1) + 1, middle - size * k, "l", -90 + k)
                add(middle + size * k + 1, middle + size * (k + 1), "r", -90 + k)
    elif style == "center":
        first = middle - size // 2 + 1
        add(first, first + size - 1, "M", 0)
        for k in range(most):
            add(first - size * (k + 1), first - size * k - 1, "L", k + 1)
            add(first + size * (k + 1), first + size * (k + 2) - 1, "R", k + 1)
    elif style == "center_intact":
        add(start, end, "M", 0)
        for k in range(most):
            add(start - size * (k + 1), start - size * k - 1, "L", k + 1)
            add(end + size * k + 1, end + size * (k + 1), "R", k + 1)
    else:
        raise ValueError(f"no window style {style}")
    return out


def codon_table() -> dict[str, str]:
    """The standard genetic code, codons in the order TCAG."""
    amino = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
    return {"".join(c): a for c, a in zip(product("TCAG", repeat=3), amino)}


CODONS = codon_table()


def compare_codons(a: str, b: str, at: int) -> tuple[int, int]:
    """(synonymous, non-synonymous) of one substitution at a place (0 to 2) of a codon; (0, 0) where there is none."""
    if a[at] == b[at]:
        return 0, 0
    changed = a[:at] + b[at] + a[at + 1 :]
    return (1, 0) if CODONS.get(a) == CODONS.get(changed) else (0, 1)


def codon_rates(codons: Sequence[str], at: int) -> tuple[float, float, float] | None:
    """(syn, nsy, stop): means over all pairs of rows; a pair with a stop codon counts as stop. Null with a gap in any codon."""
    if any(c not in CODONS for c in codons):
        return None
    rows = [(0, 0, 1) if "*" in (CODONS[a], CODONS[b]) else (*compare_codons(a, b, at), 0) for a, b in combinations(codons, 2)]
    return tuple(float(np.mean([r[i] for r in rows])) for i in range(3))
