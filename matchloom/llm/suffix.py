"""Suffix-array dedup: a common-prefix-aware distributed merge sort.

A byte goes if a string of `length` bytes that covers it also starts in a
document with a smaller id. Equal strings hold the same anchor (the leftmost
least hash of their k-grams), so that suffixes at anchors, a sixteenth of all,
are enough: an anchor and its string are equal if the suffixes there share what
the string has after the anchor, and the texts before it share the rest.

1. Documents are dealt into runs of about `run_bytes`. Each run sends the hashes
   of its anchors' k-grams; those of one document only are left out from here.
2. Each run sorts the suffixes at its other anchors, keeps equal ones once (with
   the least id), front-codes them and sends them to their parts, by k-gram.
3. Each part merges its runs with a loser tree. A candidate carries its common
   prefix with the last winner: two are compared only past what they are known
   to share, so no known prefix is compared again, and the merge yields the
   longest common prefix of neighbours. With it, and with the same for the
   texts before the anchors, strings fall into classes; each class's least id
   goes back to the runs.
4. Runs remove from their documents what a smaller id has.

Runs and parts are bounded by their sizes, not by the corpus; a passage that a
third of all documents share comes to its part once per run.

Defined results: a null text is empty; documents with a null id keep all and
are no reason to remove from others; rows with equal ids don't remove from each
other; an empty table gives no rows; further columns are ignored. What is kept
is bytes: cuts may fall inside a character.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH, GRAM = 50, 20
RUN_BYTES = 8 << 20
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xD6E8FEB86659FD93
_SPREAD = 0xC2B2AE3D27D4EB4F
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK * 2)
        steps = np.full((2, n), np.uint64(_BASE))
        steps[1] = np.uint64(pow(_BASE, -1, 1 << 64))
        steps[:, 0] = 1
        _powers[:] = np.multiply.accumulate(steps, axis=1)
    return _powers[0], _powers[1]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that stand one after another: places of anchors, first and last start of the strings that each is the anchor of, hashes of their k-grams."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_MIX)
    hashes ^= hashes >> np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    at = (_least(keys, length - gram + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(owner[: len(at)] == owner[length - 1 :])
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = at[starts]
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate(([0], turn)), np.append(turn, len(at)) - 1
    # Anchors have low hashes; mixed once more, they spread evenly over the parts.
    return at[first], starts[first], starts[last], hashes[at[first]] * np.uint64(_SPREAD)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > CHUNK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, texts[begin:]


def _run_anchors(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(number of the chunk's first document, its bytes, its sizes, its anchors)"""
    for begin, some in _chunks(texts):
        data, sizes = np.frombuffer(b"".join(some), np.uint8), np.array([len(t) for t in some], np.int64)
        yield begin, data, sizes, anchors(data, sizes, length, gram)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it; 0 for the first."""
    out = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return out


def _bytes_of(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _view(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


# --- 1: which k-grams more than one document holds -----------------------------------------


def _request(pdf: pd.DataFrame, length: int, gram: int, parts: int) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    ids, texts = pdf["id"].to_numpy(), list(pdf["text"])
    found, owners = [], []
    for begin, _, sizes, (at, _, _, hashes) in _run_anchors(texts, length, gram):
        owner = ids[begin + np.searchsorted(np.cumsum(sizes), at, side="right")]
        order = np.argsort(hashes, kind="stable")
        found.append(hashes[order])
        owners.append(owner[order])
    if not found:
        return pd.DataFrame({"part": np.empty(0, np.int64), "run": np.empty(0, np.int64), "blob": []})
    hashes, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, int)
    # The lowest bit says whether the run itself has the k-gram in two documents.
    many = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) if len(first) else np.empty(0, bool)
    sent = (hashes[first] & ~np.uint64(1)) | many.astype(np.uint64)
    cuts = np.searchsorted(_part(sent, parts), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"part": full, "run": np.full(len(full), pdf["run"].iloc[0]), "blob": [_bytes_of(sent[cuts[p] : cuts[p + 1]]) for p in full]})


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """(run, kind 0, part, blob): of each run's k-grams here, those of two documents or more."""
    blobs = [np.frombuffer(b, np.uint64) for b in pdf["blob"]]
    hashes, source = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    order = np.argsort(hashes & ~np.uint64(1), kind="stable")
    value, source, flag = hashes[order] & ~np.uint64(1), source[order], (hashes[order] & np.uint64(1)).astype(bool)
    new = np.concatenate(([True], value[1:] != value[:-1]))
    begin = np.flatnonzero(new)
    # A run may send a value twice, with and without the bit; it is then in two documents anyway.
    keep = np.repeat((np.diff(np.append(begin, len(value))) > 1) | np.logical_or.reduceat(flag, begin), np.diff(np.append(begin, len(value))))
    value, source = value[keep], source[keep]
    order = np.argsort(source, kind="stable")
    value, source = value[order], source[order]
    cuts = np.searchsorted(source, np.arange(len(blobs) + 1))
    full = np.flatnonzero(np.diff(cuts))
    runs = pdf["run"].to_numpy()
    return pd.DataFrame({"run": runs[full], "kind": np.zeros(len(full), np.int64), "part": np.full(len(full), pdf["part"].iloc[0]), "blob": [_bytes_of(np.unique(value[cuts[i] : cuts[i + 1]])) for i in full]})


# --- 2: sorted runs of suffixes ------------------------------------------------------------


class _Entries:
    """A run's suffixes at shared anchors, equal ones once, in order of part and suffix.

    rows: `length` bytes from the anchor on, then `length - gram` before it,
    then the least and the greatest number of bytes that a string of this
    anchor has before it. Bytes that no string covers are 0.
    """

    def __init__(self, pdf: pd.DataFrame, shared: np.ndarray, length: int, gram: int, parts: int):
        before = length - gram
        self.ids, self.texts = pdf["id"].to_numpy(), list(pdf["text"])
        rows, docs, places, part = [], [], [], []
        for begin, data, sizes, (at, first, last, hashes) in _run_anchors(self.texts, length, gram):
            values = hashes & ~np.uint64(1)
            spot = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
            keep = shared[spot] == values if len(shared) else np.zeros(len(at), bool)
            if not keep.any():
                continue
            at, first, last = at[keep], first[keep], last[keep]
            padded = np.concatenate((np.zeros(before, np.uint8), data, np.zeros(length, np.uint8)))
            around = np.lib.stride_tricks.sliding_window_view(padded, before + length)[at]
            least, most = (at - last).astype(np.uint8), (at - first).astype(np.uint8)
            column = np.arange(before + length)
            around = np.where((column >= before - most[:, None].astype(int)) & (column < before + length - least[:, None].astype(int)), around, 0)
            rows.append(np.concatenate((around[:, before:], around[:, :before], least[:, None], most[:, None]), axis=1).astype(np.uint8))
            ends = np.cumsum(sizes)
            doc = np.searchsorted(ends, at, side="right")
            docs.append(begin + doc)
            places.append(at - (ends - sizes)[doc])
            part.append(_part(values[keep], parts).astype(np.int64))
        width = 2 * length - gram + 2
        rows = np.concatenate(rows) if rows else np.empty((0, width), np.uint8)
        self.docs, self.places = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, places))
        part = np.concatenate(part) if part else np.empty(0, np.int64)
        order = np.argsort(_view(rows), kind="stable") if len(rows) else np.empty(0, np.int64)
        order = order[np.argsort(part[order], kind="stable")]
        rows, part, self.docs, self.places = rows[order], part[order], self.docs[order], self.places[order]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1) | (part[1:] != part[:-1]))) if len(rows) else np.empty(0, bool)
        self.begin = np.flatnonzero(new)  # of each entry's holders
        self.end = np.append(self.begin[1:], len(rows))
        self.rows, self.part = rows[self.begin], part[self.begin]
        self.cuts = np.searchsorted(self.part, np.arange(parts + 1))


def _send(pdf: pd.DataFrame, answers: pd.DataFrame, length: int, gram: int, parts: int) -> pd.DataFrame:
    shared = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in answers["blob"])]))
    e = _Entries(pdf, shared, length, gram, parts)
    full = np.flatnonzero(np.diff(e.cuts))
    holders = e.ids[e.docs] if len(e.docs) else np.empty(0, np.int64)
    low = np.minimum.reduceat(holders, e.begin) if len(e.begin) else holders
    high = np.maximum.reduceat(holders, e.begin) if len(e.begin) else holders
    out = []
    for p in full:
        s = slice(e.cuts[p], e.cuts[p + 1])
        rows = e.rows[s]
        common = _common(rows[:, :length])
        rest = rows[:, :length][np.arange(length) >= common[:, None]]  # front-coded: what is new in each suffix
        out.append(zlib.compress(b"".join(map(_bytes_of, (common, rest, rows[:, length:], low[s].astype(np.int64), (high != low)[s].astype(np.uint8)))), 1))
    run = pdf["run"].iloc[0] if len(pdf) else 0
    counts = np.diff(e.cuts)[full]
    return pd.DataFrame({"part": full, "run": np.full(len(full), run), "n": counts, "blob": out})


# --- 3: merge with a loser tree ------------------------------------------------------------


def _front_decoded(common: list[int], rest: bytes, length: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for c in common:
        end = at + length - c
        last = last[:c] + rest[at:end]
        at = end
        out.append(last)
    return out


def merge(runs: list[list[bytes]], commons: list[list[int]], length: int) -> tuple[list[int], list[int]]:
    """Sorted runs, each with its neighbours' common prefixes. Returns the run that each next suffix comes from, and its common prefix with the one before it."""
    k = 1
    while k < len(runs):
        k *= 2
    many = len(runs)
    heads = [0] * many
    sizes = [len(r) for r in runs]
    text = [r[0] if r else None for r in runs] + [None] * (k - many)
    known = [0] * k  # of each run's head with the last winner
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads. Only what lies past an equal known prefix is compared."""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ca, cb = known[a], known[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        while ca < length and x[ca] == y[ca]:
            ca += 1
        if ca == length or x[ca] < y[ca]:
            known[b] = ca
            return a, b
        known[a] = ca
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        upper = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[node + i // 2] = lost
            upper.append(w)
        level = upper
    w = level[0]
    source, shared = [], []
    for _ in range(sum(sizes)):
        source.append(w)
        shared.append(known[w])
        heads[w] += 1
        h = heads[w]
        if h < sizes[w]:
            text[w], known[w] = runs[w][h], commons[w][h]
        else:
            text[w] = None
        at = (k + w) >> 1
        while at:
            other = loser[at]
            y = text[other]
            if y is not None:
                x = text[w]
                if x is None:
                    loser[at], w = w, other
                else:
                    ca, cb = known[w], known[other]
                    if ca < cb:
                        loser[at], w = w, other
                    elif ca == cb:
                        while ca < length and x[ca] == y[ca]:
                            ca += 1
                        if ca == length or x[ca] < y[ca]:
                            known[other] = ca
                        else:
                            known[w] = ca
                            loser[at], w = w, other
            at >>= 1
    return source, shared


def _classes(common: np.ndarray, least: int) -> np.ndarray:
    return np.cumsum(common < least)


def _merge_part(pdf: pd.DataFrame, length: int, gram: int) -> pd.DataFrame:
    before = length - gram
    pdf = pdf.sort_values("run", kind="stable")
    runs, commons, tails, lows, manys = [], [], [], [], []
    for n, blob in zip(pdf["n"], map(zlib.decompress, pdf["blob"]), strict=True):
        common = np.frombuffer(blob, np.uint8, n)
        size = int(n * length - common.sum(dtype=np.int64))
        runs.append(_front_decoded(common.tolist(), blob[n : n + size], length))
        commons.append(common.tolist())
        at = n + size
        tails.append(np.frombuffer(blob, np.uint8, n * (before + 2), at).reshape(n, before + 2))
        at += n * (before + 2)
        lows.append(np.frombuffer(blob, np.int64, n, at))
        manys.append(np.frombuffer(blob, np.uint8, n, at + 8 * n))
    source, common = merge(runs, commons, length)
    del runs, commons
    source, common = np.array(source, np.int32), np.array(common, np.uint8)
    # The nth suffix of a run is the run's nth entry; in order of the merge:
    sizes = np.array([len(t) for t in tails])
    order = np.empty(len(source), np.int64)
    order[np.argsort(source, kind="stable")] = np.arange(len(source))
    entry = order - np.concatenate(([0], np.cumsum(sizes)))[source]
    tail, low, many = np.concatenate(tails)[order], np.concatenate(lows)[order], np.concatenate(manys)[order]
    least, most = tail[:, before], tail[:, before + 1]
    ahead = tail[:, before - 1 :: -1] if before else tail[:, :0]  # the bytes before the anchor, from it backwards
    ahead = ahead[:, :before]
    sort = np.argsort(_view(ahead), kind="stable") if before else np.arange(len(tail))
    ahead_common = _common(ahead[sort]) if before else np.zeros(len(tail), np.uint8)
    got = []
    for o in range(before + 1):
        here = np.flatnonzero((least <= o) & (o <= most))
        if len(here) < 1:
            continue
        left = np.empty(len(tail), np.int64)
        left[sort] = _classes(ahead_common, o)
        key = _classes(common, length - o)[here] * (len(tail) + 1) + left[here]
        by = np.argsort(key, kind="stable")
        key, here = key[by], here[by]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lowest = np.repeat(np.minimum.reduceat(low[here], begin), np.diff(np.append(begin, len(here))))
        tell = (lowest < low[here]) | (many[here] > 0)
        got.append((here[tell], np.full(int(tell.sum()), o, np.int64), lowest[tell]))
    if not sum(len(g[0]) for g in got):
        return pd.DataFrame({"run": np.empty(0, np.int64), "kind": np.empty(0, np.int64), "part": np.empty(0, np.int64), "blob": []})
    where, o, lowest = (np.concatenate([g[i] for g in got]) for i in range(3))
    order = np.lexsort((o, where))
    where, o, lowest = where[order], o[order], lowest[order]
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (o[1:] != o[:-1] + 1) | (lowest[1:] != lowest[:-1])))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(where)) - 1
    where, low_o, high_o, lowest = where[first], o[first], o[last], lowest[first]
    order = np.argsort(source[where], kind="stable")
    cuts = np.searchsorted(source[where][order], np.arange(len(sizes) + 1))
    out, full = [], np.flatnonzero(np.diff(cuts))
    for i in full:
        x = order[cuts[i] : cuts[i + 1]]
        out.append(np.int64(len(x)).tobytes() + _bytes_of(entry[where[x]].astype(np.int32)) + _bytes_of(low_o[x].astype(np.uint8)) + _bytes_of(high_o[x].astype(np.uint8)) + _bytes_of(lowest[x].astype(np.int64)))
    return pd.DataFrame({"run": pdf["run"].to_numpy()[full], "kind": np.ones(len(full), np.int64), "part": np.full(len(full), pdf["part"].iloc[0]), "blob": out})


# --- 4: remove -----------------------------------------------------------------------------


def _remove(pdf: pd.DataFrame, answers: pd.DataFrame, length: int, gram: int, parts: int, keep_bytes: bool) -> pd.DataFrame:
    shared = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in answers["blob"][answers["kind"] == 0])]))
    e = _Entries(pdf, shared, length, gram, parts)
    doc, begin, end = [], [], []
    for part, blob in answers[answers["kind"] == 1][["part", "blob"]].itertuples(index=False):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        entry = np.frombuffer(blob, np.int32, n, 8) + e.cuts[part]
        low_o, high_o = np.frombuffer(blob, np.uint8, n, 8 + 4 * n), np.frombuffer(blob, np.uint8, n, 8 + 5 * n)
        lowest = np.frombuffer(blob[8 + 6 * n :], np.int64, n)
        sizes = (e.end - e.begin)[entry]
        row = np.repeat(np.arange(n), sizes)
        holder = np.repeat(e.begin[entry] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(row))
        goes = e.ids[e.docs[holder]] > lowest[row]
        row, holder = row[goes], holder[goes]
        doc.append(e.docs[holder])
        begin.append(e.places[holder] - high_o[row].astype(np.int64))
        end.append(e.places[holder] - low_o[row].astype(np.int64) + length)
    doc, begin, end = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (doc, begin, end))
    order = np.argsort(doc, kind="stable")
    doc, begin, end = doc[order], begin[order], end[order]
    cuts = np.searchsorted(doc, np.arange(len(e.texts) + 1))
    removed, spans, digest, kept = [], [], [], []
    for i, text in enumerate(e.texts):
        n, runs = 0, 0
        if cuts[i] < cuts[i + 1]:
            s = slice(cuts[i], cuts[i + 1])
            change = np.bincount(begin[s], minlength=len(text) + 1) - np.bincount(end[s], minlength=len(text) + 1)
            gone = np.cumsum(change[:-1]) > 0
            n, runs = int(gone.sum()), int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
            text = np.frombuffer(text, np.uint8)[~gone].tobytes()
        removed.append(n)
        spans.append(runs)
        digest.append(hashlib.sha256(text).hexdigest())
        kept.append(text if keep_bytes else None)
    return pd.DataFrame({"id": e.ids, "n_bytes": [len(t) for t in e.texts], "n_removed": removed, "n_spans": spans, "kept_sha256": digest, "kept": kept})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, keep_bytes: bool = True) -> DataFrame:
    """Per document row: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes left) if `keep_bytes`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // run_bytes + 1)
    parts = runs
    dealt = rows.where(F.col("id").isNotNull()).withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("long"))
    by_run = dealt.groupBy("run")
    answer = "run bigint, kind bigint, part bigint, blob binary"
    shared = by_run.applyInPandas(lambda pdf: _request(pdf, length, gram, parts), "part bigint, run bigint, blob binary").groupBy("part").applyInPandas(_answer, answer)
    sent = by_run.cogroup(shared.groupBy("run")).applyInPandas(lambda a, b: _send(a, b, length, gram, parts), "part bigint, run bigint, n bigint, blob binary")
    least = sent.groupBy("part").applyInPandas(lambda pdf: _merge_part(pdf, length, gram), answer)
    # Documents go to their runs once: the three steps that read them share that exchange.
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    out = by_run.cogroup(shared.union(least).groupBy("run")).applyInPandas(lambda a, b: _remove(a, b, length, gram, parts, keep_bytes), schema)
    without = rows.where(F.col("id").isNull())
    whole = without.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept"))
    return out.union(whole) if keep_bytes else out.union(whole).drop("kept")


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, keep_bytes=False).withColumnRenamed("id", "doc_id")
