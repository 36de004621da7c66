"""Pairwise alignment and other dynamic programming, batched in pandas functions (no Spark operator expresses these).

All modes share one affine-gap recurrence (Gotoh), one row of the target at a time, vectorised over the query; what
differs is which ends are free.  Penalties are positive: a gap of n costs open + n * extend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.scoring import blosum62
from ..plans.iterate import cut

NEGATIVE = -(10**9)
#: (free begin of query, free begin of target, free end of query, free end of target)
MODES = {"global": (False, False, False, False), "semiglobal": (True, True, True, True), "query_in_target": (False, True, False, True), "overlap": (True, False, False, True), "left": (False, False, True, True), "right": (True, True, False, False)}


def matrix_of(table: dict[str, int] | None = None) -> tuple[np.ndarray, dict[str, int]]:
    table = table or blosum62()
    letters = sorted({k[0] for k in table})
    at = {c: i for i, c in enumerate(letters)}
    m = np.zeros((len(letters), len(letters)), np.int64)
    for (a, b), x in table.items():
        m[at[a], at[b]] = x
    return m, at


def align(query: str, target: str, mode: str = "global", gap_open: int = 10, gap_extend: int = 1, band: int | None = None, table: dict[str, int] | None = None) -> tuple[int, int, int, int, int, str]:
    """``(score, q_begin, q_end, t_begin, t_end, trace)``, regions from 0 and half-open, trace of M, I (query only), D.

    ``mode`` is local or one of ``MODES``; outside ``band`` cells around the diagonal nothing is allowed.
    """
    m, at = matrix_of(table)
    x = at.get("X", 0)
    q, t = np.array([at.get(c, x) for c in query], int), np.array([at.get(c, x) for c in target], int)
    n, k, local = len(q), len(t), mode == "local"
    fq, ft, eq, et = (True,) * 4 if local else MODES[mode]
    first = -(gap_open + gap_extend * np.arange(1, n + 1))
    h = np.full((k + 1, n + 1), NEGATIVE, np.int64)
    f = np.full((k + 1, n + 1), NEGATIVE, np.int64)  # gap in the query (target residue alone): D
    e = np.full((k + 1, n + 1), NEGATIVE, np.int64)  # gap in the target: I
    h[0, 0] = 0
    h[0, 1:] = 0 if fq else first
    if not fq:
        e[0, 1:] = first
    h[1:, 0] = 0 if ft else -(gap_open + gap_extend * np.arange(1, k + 1))
    if not ft:
        f[1:, 0] = h[1:, 0]
    cols = np.arange(n + 1)
    for j in range(1, k + 1):
        f[j, 1:] = np.maximum(f[j - 1, 1:], h[j - 1, 1:] - gap_open) - gap_extend
        best = np.maximum(h[j - 1, :-1] + m[t[j - 1], q], f[j, 1:])
        if local:
            best = np.maximum(best, 0)
        row = np.r_[h[j, 0], best]
        if band is not None:
            row[np.abs(cols - j) > band] = NEGATIVE
        # gaps along the query: e[i] = max over l < i of row[l] - open - (i - l) * extend
        lead = np.maximum.accumulate(row + gap_extend * cols)
        e[j, 1:] = lead[:-1] - gap_open - gap_extend * cols[1:]
        h[j] = np.maximum(row, e[j])
        if band is not None:
            h[j, np.abs(cols - j) > band] = NEGATIVE
    if local:
        j, i = np.unravel_index(int(h.argmax()), h.shape)
    else:
        ends = [(h[k, n], k, n)]
        ends += [(h[k, i], k, i) for i in range(n)] if eq else []
        ends += [(h[j, n], j, n) for j in range(k)] if et else []
        _, j, i = max(ends, key=lambda z: (z[0], z[1] + z[2]))
    score, q_end, t_end, state, trace = int(h[j, i]), int(i), int(j), "H", []
    while i or j:
        if state == "H":
            if local and h[j, i] == 0 or (j == 0 and fq) or (i == 0 and ft):
                break
            if i and j and h[j, i] == h[j - 1, i - 1] + m[t[j - 1], q[i - 1]]:
                trace.append("M")
                i, j = i - 1, j - 1
            elif i and h[j, i] == e[j, i]:
                state = "E"
            elif j and h[j, i] == f[j, i]:
                state = "F"
            else:
                break
        elif state == "E":
            trace.append("I")
            state = "H" if i == 1 or e[j, i] == h[j, i - 1] - gap_open - gap_extend else "E"
            i -= 1
        else:
            trace.append("D")
            state = "H" if j == 1 or f[j, i] == h[j - 1, i] - gap_open - gap_extend else "F"
            j -= 1
    return score, int(i), q_end, int(j), t_end, "".join(reversed(trace))


def x_drop(query: str, target: str, q_at: int, t_at: int, size: int, drop: int = 25, table: dict[str, int] | None = None) -> tuple[int, int, int]:
    """Ungapped extension of a word hit both ways until the score falls ``drop`` below its best: (score, q_begin, q_end)."""
    table = table or blosum62()
    s = lambda a, b: table.get(a + b, -1)
    score = sum(s(query[q_at + i], target[t_at + i]) for i in range(size))
    lo, hi = q_at, q_at + size
    for step in (1, -1):
        best = run = 0
        i, j = (q_at + size, t_at + size) if step > 0 else (q_at - 1, t_at - 1)
        while 0 <= i < len(query) and 0 <= j < len(target):
            run += s(query[i], target[j])
            if run > best:
                best = run
                lo, hi = (lo, i + 1) if step > 0 else (i, hi)
            if run < best - drop:
                break
            i, j = i + step, j + step
        score += best
    return score, lo, hi


def chain(hsps: list[tuple[int, int, int, int, int]], band: int = 20) -> tuple[int, list[int]]:
    """Best chain of ``(q_begin, q_end, t_begin, t_end, score)`` that go on in both sequences within ``band`` of the
    diagonal: (score, indices)."""
    order = sorted(range(len(hsps)), key=lambda i: (hsps[i][0], hsps[i][2]))
    best: dict[int, tuple[int, int]] = {}
    for n, i in enumerate(order):
        own = hsps[i]
        top = (own[4], -1)
        for j in order[:n]:
            p = hsps[j]
            if p[1] <= own[0] and p[3] <= own[2] and abs((own[2] - own[0]) - (p[2] - p[0])) <= band:
                top = max(top, (best[j][0] + own[4], j))
        best[i] = top
    if not best:
        return 0, []
    at = max(best, key=lambda i: (best[i][0], -i))
    score, path = best[at][0], []
    while at >= 0:
        path.append(at)
        at = best[at][1]
    return score, path[::-1]


ALIGNED = "score int, q_begin int, q_end int, t_begin int, t_end int, trace string"


def align_pairs(pairs: DataFrame, mode: str = "global", gap_open: int = 10, gap_extend: int = 1, band: int | None = None) -> DataFrame:
    """Every row of ``pairs(qid, rid, query, target)`` aligned, in batches; pairs are dealt evenly before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [align(a, b, mode, gap_open, gap_extend, band) for a, b in zip(pdf["query"], pdf["target"], strict=True)]
            out = pd.DataFrame(rows, columns=["score", "q_begin", "q_end", "t_begin", "t_end", "trace"])
            out.insert(0, "rid", pdf["rid"].to_numpy())
            out.insert(0, "qid", pdf["qid"].to_numpy())
            yield out

    types = dict(pairs.dtypes)
    return pairs.select("qid", "rid", "query", "target").repartition("qid", "rid").mapInPandas(run, f"qid {types['qid']}, rid {types['rid']}, {ALIGNED}")


#: Cells that one step of ``local_scores`` fills, about: its few tables then stay near the processor.
CELLS = 1 << 17


def local_scores(queries: list[str], targets: list[str], of: list[tuple[int, int]], gap_open: int = 10, gap_extend: int = 1, table: dict[str, int] | None = None) -> np.ndarray:
    """``align(query, target, "local")``'s score for each pair ``(query, target)`` of ``of``, without places and trace.

    Pairs of targets about as long go through one step for each place of their queries, which fills a row of cells along
    every target.  All values have ``gap_extend * (i + j)`` added, so gaps that go on change nothing: a gap along the target
    is a running maximum, one along the query a maximum with the row before.
    """
    m, at = matrix_of(table)
    x = at.get("X", 0)
    code = lambda t: np.array([at.get(c, x) for c in t], np.int64)
    qs, ts = [code(t) for t in queries], [code(t) for t in targets]
    out = np.zeros(len(of), np.int64)
    order = sorted((i for i, (q, t) in enumerate(of) if len(qs[q]) and len(ts[t])), key=lambda i: (-len(ts[of[i][1]]), of[i][1]))
    while order:
        n = len(ts[of[order[0]][1]])
        some, order = order[: max(1, CELLS // n)], order[max(1, CELLS // n) :]
        some.sort(key=lambda i: -len(qs[of[i][0]]))
        lens = np.array([len(qs[of[i][0]]) for i in some])
        highest = (int(m.max()) + 2 * gap_extend) * int(lens[0]) + gap_extend * n + gap_open
        kind = np.int16 if highest < 30_000 else np.int32
        # what each residue scores along each target; the padding behind a target scores as low as nothing else
        held = list(dict.fromkeys(of[i][1] for i in some))
        gain = np.full((len(held), len(m), n), -min(highest, 10_000) - 1, kind)
        for r, t in enumerate(held):
            gain[r, :, : len(ts[t])] = m[:, ts[t]] + 2 * gap_extend
        gain = gain.reshape(-1, n)
        first = {t: r * len(m) for r, t in enumerate(held)}
        rows = np.zeros((len(some), lens[0]), np.int64)
        for r, i in enumerate(some):
            rows[r, : lens[r]] = first[of[i][1]] + qs[of[i][0]]
        floor = (gap_extend * np.arange(n + 1)).astype(kind)  # zero
        h = np.repeat(floor[None], len(some), 0)
        f, best, d, e = np.full((len(some), n), -gap_open, kind), np.zeros((len(some), n), kind), np.empty((len(some), n), kind), np.empty((len(some), n), kind)
        for j in range(lens[0]):
            k = int(np.searchsorted(-lens, -j))  # queries that are longer
            hk, fk, bk, dk, ek = h[:k], f[:k], best[:k], d[:k], e[:k]
            np.subtract(hk[:, 1:], kind(gap_open), out=ek)
            np.maximum(fk, ek, out=fk)
            np.take(gain, rows[:k, j], 0, out=dk, mode="clip")
            dk += hk[:, :-1]
            floor += kind(gap_extend)
            np.maximum(dk, fk, out=dk)
            np.maximum(dk, floor[1:], out=dk)
            np.maximum.accumulate(dk, axis=1, out=ek)
            ek -= kind(gap_open)
            hk[:, 0] = floor[0]
            hk[:, 1] = dk[:, 0]
            np.maximum(dk[:, 1:], ek[:, :-1], out=hk[:, 2:])
            np.subtract(dk, floor[1:], out=dk)  # no best ends with a gap
            np.maximum(bk, dk, out=bk)
        out[some] = best.max(1)
    return out


#: Pairs that a task of ``score_pairs`` gets, about.
SCORED = 1_000


def score_pairs(pairs: DataFrame, queries: DataFrame, seqs: DataFrame, gap_open: int = 10, gap_extend: int = 1) -> DataFrame:
    """``(qid, rid, score)``: local alignment scores of ``pairs(qid, rid)``.  A sequence is sent once for every 64 of its
    queries, not for each."""
    pairs = cut(pairs)
    tasks = max(1, pairs.count() // SCORED)
    asked = pairs.join(queries.select(F.col("rid").alias("qid"), F.col("seq").alias("query")), "qid").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(64)))
    blocks = pairs.groupBy("rid").agg(F.ceil(F.count(F.lit(1)) / 64).alias("blocks"))
    lists = asked.join(blocks, "rid").groupBy("rid", F.pmod("block", "blocks").alias("block")).agg(F.collect_list(F.struct("qid", "query")).alias("asked"))
    full = lists.join(seqs.select("rid", F.col("seq").alias("target")), "rid").select("rid", "target", "asked").repartition(tasks, "rid", "asked")
    types = {"qid": dict(pairs.dtypes)["qid"], "rid": dict(pairs.dtypes)["rid"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                lens = pc.list_value_length(part.column(2)).to_pylist()
                flat = pc.list_flatten(part.column(2))
                coded = flat.field("query").dictionary_encode()
                target = np.repeat(np.arange(len(part)), lens)
                of = list(zip(coded.indices.to_pylist(), target.tolist(), strict=True))
                score = local_scores(coded.dictionary.to_pylist(), part.column(1).to_pylist(), of, gap_open, gap_extend)
                yield pa.RecordBatch.from_arrays([flat.field("qid"), part.column(0).take(pa.array(target)), pa.array(score, pa.int32())], names=["qid", "rid", "score"])

    return full.mapInArrow(run, f"qid {types['qid']}, rid {types['rid']}, score int")


def extend_hits(hits: DataFrame, size: int, drop: int = 25) -> DataFrame:
    """x-drop extension of ``hits(qid, rid, qpos, pos, query, target)``, places from 1: with score, begin and end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x_drop(r.query, r.target, r.qpos - 1, r.pos - 1, size, drop) for r in pdf.itertuples()] if len(pdf) else []
            out = pdf[["qid", "rid", "qpos", "pos"]].reset_index(drop=True)
            out["score"], out["q_begin"], out["q_end"] = ([r[i] for r in rows] for i in range(3))
            yield out

    types = dict(hits.dtypes)
    return hits.mapInPandas(run, f"qid {types['qid']}, rid {types['rid']}, qpos long, pos long, score int, q_begin int, q_end int")


def profile_viterbi(match: np.ndarray, insert: np.ndarray, moves: np.ndarray, seq: str, residues: str = "ACDEFGHIKLMNPQRSTVWY", background: np.ndarray | None = None) -> float:
    """Score of a sequence against a profile: global over the profile, best path of match, insert and delete states.

    Inputs are costs (negative logs); moves by state in the order MM MI MD IM II DM DD.  The score is the sum of
    background minus emission costs minus moves.
    """
    states, n = len(match), len(seq)
    null = np.zeros(20) if background is None else background
    index = {c: i for i, c in enumerate(residues)}
    s = [index.get(c) for c in seq]
    gain = lambda row, c: 0.0 if c is None else null[c] - row[c]
    low = -np.inf
    m, i_, d = (np.full((states + 1, n + 1), low) for _ in range(3))
    m[0, 0] = 0.0
    for k in range(states + 1):
        for j in range(n + 1):
            if k and j:
                m[k, j] = gain(match[k - 1], s[j - 1]) + max(m[k - 1, j - 1] - moves[k - 1][0], i_[k - 1, j - 1] - moves[k - 1][3], d[k - 1, j - 1] - moves[k - 1][5])
            if j:
                i_[k, j] = gain(insert[k], s[j - 1]) + max(m[k, j - 1] - moves[k][1], i_[k, j - 1] - moves[k][4])
            if k:
                d[k, j] = max(m[k - 1, j] - moves[k - 1][2], d[k - 1, j] - moves[k - 1][6])
    return float(max(m[states, n] - moves[states][0], i_[states, n] - moves[states][3], d[states, n] - moves[states][5]))


def profile_words(match, word_length: int, least: float, background: np.ndarray, residues: str = "ACDEFGHIKLMNPQRSTVWY") -> list[tuple[int, str, float]]:
    """Words whose score against some stretch of a profile reaches ``least``: (state, word, score), by branch and bound."""
    gains = [background - np.asarray(row) for row in match]
    out = []
    for k in range(len(gains) - word_length + 1):
        part = gains[k : k + word_length]
        rest = [sum(float(g.max()) for g in part[i + 1 :]) for i in range(word_length)]
        stack = [("", 0.0)]
        while stack:
            word, score = stack.pop()
            if len(word) == word_length:
                out.append((k, word, score))
                continue
            g = part[len(word)]
            stack += [(word + c, score + float(g[i])) for i, c in enumerate(residues) if score + float(g[i]) + rest[len(word)] >= least]
    return sorted(out)


def profile_consensus(match, residues: str = "ACDEFGHIKLMNPQRSTVWY") -> str:
    """The cheapest residue of each state, ties to the lowest index."""
    return "".join(residues[int(np.argmin(row))] for row in match)


def correct_read(seq: str, k: int, trusted: set[str], most: int, residues: str = "ACDEFGHIKLMNPQRSTVWY") -> str:
    """Fewest substitutions (at most ``most``) after which all k-mers are trusted; the read as it is if there are none.
    Best first by substitutions made, then by how far the read is trusted, then by text."""
    import heapq

    def bad(s: str) -> int:
        return next((i for i in range(len(s) - k + 1) if s[i : i + k] not in trusted), -1)

    heap, seen = [(0, 0, seq)], {seq}
    while heap:
        made, _, s = heapq.heappop(heap)
        at = bad(s)
        if at < 0:
            return s
        if made == most:
            continue
        # the last position of the first untrusted k-mer, or any of it at the start
        for i in range(at, at + k) if at == 0 else (at + k - 1,):
            for c in residues:
                new = s[:i] + c + s[i + 1 :]
                if c != s[i] and new[at : at + k] in trusted and new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (made + 1, -at, new))
    return seq


def multiple_alignment(placed: DataFrame) -> DataFrame:
    """Reads of a path ``(path, rid, start, seq, inserts)`` in common columns: a column gets as many gap columns as the
    longest insertion after it.  ``inserts`` maps a reference position to how many residues a read inserts after it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide: dict[int, int] = {}
        for ins in pdf["inserts"]:
            for at, n in ins.items() if isinstance(ins, dict) else ins:
                wide[at] = max(wide.get(at, 0), n)
        rows = []
        for r in pdf.itertuples():
            ins = dict(r.inserts if isinstance(r.inserts, list | tuple | np.ndarray) else r.inserts.items())
            text, pos, i = "", r.start, 0
            lead = r.start + sum(n for at, n in wide.items() if at < r.start)
            while i < len(r.seq):
                text += r.seq[i]
                i += 1
                own = ins.get(pos, 0)
                if pos in wide and i < len(r.seq):
                    text += r.seq[i : i + own] + "-" * (wide[pos] - own)
                    i += own
                pos += 1
            rows.append((r.path, r.rid, "." * lead + text))
        return pd.DataFrame(rows, columns=["path", "rid", "row"])

    types = dict(placed.dtypes)
    return placed.groupBy("path").applyInPandas(run, f"path {types['path']}, rid {types['rid']}, row string")


def levenshtein(pairs: DataFrame, a: str, b: str, most: int | None = None) -> DataFrame:
    return pairs.withColumn("distance", F.levenshtein(a, b, most) if most is not None else F.levenshtein(a, b))


#: Pairs that a task makes, about.
PAIRS = 4_000_000


def edits_within(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(a, b, distance)``: edit distance of every pair of ``rows(*by, text, id)`` with equal ``by``, a < b.

    Equal texts of a group are one class: a distance is found once for two classes, and their ids are paired after it.
    Pairs are dealt over as many tasks as their number asks for; rows of a group beyond a task's share are dealt too.
    """
    sizes = cut(rows.where(F.expr(" and ".join(f"{c} is not null" for c in by))).groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    parts = max(1, int(sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0) // PAIRS)
    # one of two rows of a pair stands in a block only, the other in every block of its group
    blocks = sizes.select(*by, F.ceil(F.col("n").cast("double") * F.col("n") / PAIRS).cast("int").alias("blocks"))
    dealt = rows.join(blocks, by)
    ids = F.collect_list("id").alias
    one = dealt.groupBy(*by, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.col("text").alias("x")).agg(ids("left"))
    every = dealt.groupBy(*by, "blocks", F.col("text").alias("y")).agg(ids("right")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    on = [*by, "block"]
    met = one.repartition(parts, *on).join(every.repartition(parts, *on), on)
    # each pair of classes comes in both orders: the second class is given the larger ids
    pairs = met.withColumn("distance", F.levenshtein("x", "y")).select("distance", "right", F.explode("left").alias("a"))
    return pairs.select("a", "distance", F.explode("right").alias("b")).where("a < b").select("a", "b", "distance")
