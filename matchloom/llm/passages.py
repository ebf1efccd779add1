"""Near-duplicate passages by compact windows.

A document is the sequence of its word shingles. For each of `functions` hashes
of them, the nodes of a Cartesian tree whose subtrees span a passage's length or
more are its compact windows: all subsequences of such a window that hold its
node have the node's hash as their min-hash. Equal passages thus share a node
for every hash, near ones for most.

1. Documents are dealt into runs. Each window has two keys: its node's hash with
   the least hash of the shingles just before it, and of those just after it. A
   passage that holds the node holds one side or the other. Keys that only one
   document has are left out from here.
2. Texts with the same words are linked to the least id, and it alone goes on.
3. Equal passages: within windows of shared keys, whole runs of `words` words
   are hashed, and of each EVERY neighbours the one of least hash is kept. Two
   documents that share `words` + EVERY - 1 words (57) share one of these hashes,
   whatever else shares their nodes; all that share one are linked to the least
   of them.
4. Near passages: the windows of a key's holders are joined with those of one of
   them, the key's root, the one that comes first in an order of the ids. For
   each pair, windows whose diagonals lie near each other are intersected; a
   pair is a candidate if `enough` hashes or more meet in one such interval.
   Candidates are verified: some `words` consecutive words of one, and as many
   of the other on nearly the same diagonal, must have a Jaccard similarity of
   shingles of `least` or more. What was verified joins classes; where a key's
   holders are not of one class yet, the next round has another order of the
   ids, so that documents that share only a part of a passage don't stay in the
   way: `ROUNDS` at most, and none after one that found nothing.
5. What is still divided then is settled by a prefix filter, which loses nothing.
   All places are judged that may begin a passage with `enough` divided keys. In
   one order for all documents, those shingles first that fewer of them have, two
   passages as alike as `least` share one of the first few of each (for 46
   different ones, of the first six): the others would be too many to differ.
   Documents of different classes that share such a shingle are verified around
   it; of those whose surroundings of it are equal, one meets the others.
6. Classes are the connected components of the links.

No texts move after step 1: runs send the hashes of the shingles in shared
windows, 4 bytes each. No step has all pairs of a key's holders.

Equal passages of 50 words or more are found for certain, and so are near ones
whose keys agree under `enough` hashes. Others can be missed (for the min-hashes
alone, a chance of 0.0016 at a similarity of 0.8 and 6 hashes); see the README
for the recall that was measured.

Defined results: null and empty texts, and those of fewer than `words` words,
have no passages and are classes of their own; repeated rows count once per id;
an id that comes with several texts counts as one document that holds them all;
null ids are left alone in a null class; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import written
from matchloom.llm.components import connected_components
from matchloom.llm.suffix import _chunks, _least, _part, _power

WORDS, SHINGLE, LEAST, FUNCTIONS, ENOUGH = 50, 5, 0.8, 6, 2
#: Shingles on each side of a node that its keys look at.
SIDE = 16
RUN_BYTES = 6 << 20
#: Orders of the ids by which keys get their roots, one after the other, before the rest is settled by shingles.
ROUNDS = 3
#: Of so many neighbouring equal windows, one at least is looked at.
EVERY = 8
#: Diagonals at most so far apart count as one.
DRIFT = 8

#: Bytes to what they count as: lower case, and a space for all but letters, digits and non-ASCII.
TABLE = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_ODD = np.uint64(0x9FB21C651E98DF25)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    values = (values + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _ODD
    values ^= values >> np.uint64(29)
    values *= _MIX
    values ^= values >> np.uint64(32)
    return values


def shingles_of(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all the texts in one go: hashes of `shingle` consecutive words, whose text each word is in, and a digest of each text's words.

    A place that has too few words of its text ahead has a hash without meaning.
    """
    data = np.frombuffer(b"\n".join((t or "").encode().translate(TABLE) for t in texts), np.uint8)
    line = data == 10
    edge = np.diff(np.concatenate(([1], ((data == 32) | line).astype(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    owner = np.searchsorted(np.flatnonzero(line), begin)
    power, inverse = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    word = _mixed((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64), 0)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    nth = np.arange(len(word)) - cuts[owner]
    total = np.concatenate(([np.uint64(0)], np.cumsum(_mixed(word ^ _mixed(nth.astype(np.uint64), 3), 4))))
    digest = (total[cuts[1:]] - total[cuts[:-1]]).view(np.int64)
    n = max(len(word) - shingle + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = out * _ODD + word[k : k + n]
    return _mixed(out, 5), owner, digest


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return shingles_of([text], shingle)[0]


def compact_windows(hashes: np.ndarray, width: int, owner: np.ndarray | None = None, shingle: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, first, last) of the Cartesian trees' nodes that span `width` places or more; ties go to the left. A tree for each owner.

    A node spans that much just if it is the least of some `width` neighbours;
    and what bounds its span, the nearest lower ones, span more.
    """
    if owner is None:
        owner = np.zeros(len(hashes) + shingle - 1, np.int64)
    if len(hashes) < width:
        return (np.empty(0, np.int64),) * 3
    keys = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    span = width + shingle - 2
    starts = np.flatnonzero(owner[: len(owner) - span] == owner[span:])
    at = (_least(keys, width)[starts] & _LOW).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    if not len(at):
        return (at,) * 3
    whose = owner[at]
    new = np.concatenate(([True], whose[1:] != whose[:-1]))
    low = np.searchsorted(owner, whose[new])
    high = np.searchsorted(owner, whose[new], side="right") - shingle
    # Zeros, which are no higher than any node, stand around each owner's nodes.
    to = np.arange(len(at)) + np.cumsum(new)
    value = np.zeros(to[-1] + 2, np.uint64)
    value[to] = keys[at]
    before, after = np.empty((2, len(value)), np.int64)
    before[to] = after[to] = at
    edge = np.append(to[new] - 1, len(value) - 1)
    before[edge[:-1]], after[edge[1:]] = low - 1, high + 1
    left, right = _lower(value, to, int(np.diff(edge).max()))
    return at, before[left] + 1, after[right] - 1


def _lower(value: np.ndarray, to: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the nearest values no higher than those at `to` stand on each side, less than `most` + 1 places away: steps of halving length over what is higher."""
    least = [value]
    while 1 << len(least) <= most:
        span = 1 << len(least) - 1
        least.append(np.concatenate((least[-1][:span], np.minimum(least[-1][span:], least[-1][:-span]))))
    own, left, right = value[to], to - 1, to + 1
    for k in range(len(least) - 1, -1, -1):
        left = left - ((least[k][left] > own).astype(np.int64) << k)
        right = right + ((least[k][np.minimum(right + (1 << k) - 1, len(value) - 1)] > own).astype(np.int64) << k)
    return left, right


def keys_of(texts: list[str | None], width: int, shingle: int, functions: int, made: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, ...]:
    """(key, text's number, function, first, last, node, digests): a row for each side of each window that has one; places from the text's start. made: their shingles_of."""
    hashes, owner, digest = made or shingles_of(texts, shingle)
    out = [(np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 5)]
    if len(hashes) >= width:
        near, span = _least(_mixed(hashes, 1000), SIDE), SIDE + shingle - 2
        inside = owner[: len(near)] == owner[span : span + len(near)]
        for j in range(functions):
            mixed = _mixed(hashes, j + 1)
            node, first, last = compact_windows(mixed, width, owner, shingle)
            start = np.searchsorted(owner, owner[node])
            for side, place in enumerate((node - SIDE + 1, node)):
                fits = (place >= start) & (place < len(near))
                fits[fits] = inside[place[fits]]
                key = _mixed(mixed[node[fits]] ^ near[place[fits]] * _ODD, 2000 + 2 * j + side)
                out.append((key, owner[node[fits]], np.full(len(key), j), (first - start)[fits], (last - start)[fits], (node - start)[fits]))
    return *(np.concatenate(x) for x in zip(*out, strict=True)), digest


def _texts(pdf: pd.DataFrame, words: int) -> tuple[np.ndarray, list[str]]:
    """A run's ids, each once, and their texts. Between texts of one id stand words of no other document, so that no window bridges them."""
    ids, texts = pdf["id"].to_numpy(), list(pdf["text"])
    if len(np.unique(ids)) == len(ids):
        return ids, texts
    of: dict[int, dict[str, None]] = {}
    for i, t in zip(ids, texts, strict=True):
        of.setdefault(i, {})[t] = None
    apart = {i: " " + " ".join(f"between{i}x{k}" for k in range(words)) + " " for i, t in of.items() if len(t) > 1}
    return np.array(list(of), np.int64), [apart[i].join(t) if len(t) > 1 else next(iter(t)) for i, t in of.items()]


def _run_keys(texts: list[str], width: int, shingle: int, functions: int) -> tuple[np.ndarray, ...]:
    """The keys of a run, some documents at a time."""
    out = [(np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 6)]
    for begin, some in _chunks(texts):
        key, owner, *rest = keys_of(some, width, shingle, functions)
        out.append((key, owner + begin, *rest))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed(keys: np.ndarray, size: int) -> bytes:
    """Sorted keys: the first `size` bytes of each, by place, so that what they share takes no room."""
    return zlib.compress(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes(), 1)


def _unpacked(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _cut(keys: np.ndarray, size: int) -> np.ndarray:
    """Keys to their first `size` bytes."""
    return keys & np.uint64((1 << 64) - (1 << 8 * (8 - size)))


def _request(pdf: pd.DataFrame, width: int, shingle: int, functions: int, parts: int, size: int) -> pd.DataFrame:
    """(part, run, blob, many): the run's keys, and which of them two of its documents have."""
    ids, texts = _texts(pdf, width + shingle - 1)
    key, owner, *_ = _run_keys(texts, width, shingle, functions)
    key = _cut(key, size)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    many = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin) if len(key) else np.empty(0, bool)
    sent = key[begin]
    cuts = np.searchsorted(_part(sent, parts), np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    some = [slice(cuts[p], cuts[p + 1]) for p in full]
    return pd.DataFrame({"part": full, "run": np.full(len(full), pdf["run"].iloc[0]), "blob": [_packed(sent[s], size) for s in some], "many": [np.packbits(many[s]).tobytes() for s in some]})


def _answer(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """(run, blob): of each run's keys here, those of two documents or more."""
    blobs = [_unpacked(b, size) for b in pdf["blob"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(b)).astype(bool) for m, b in zip(pdf["many"], blobs, strict=True)])
    keys, source = np.concatenate(blobs), np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
    order = np.argsort(keys, kind="stable")
    keys, source, many = keys[order], source[order], many[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(begin, len(keys)))
    keep = np.repeat((count > 1) | np.logical_or.reduceat(many, begin), count)
    keys, source = keys[keep], source[keep]
    order = np.argsort(source, kind="stable")
    keys, source = keys[order], source[order]
    cuts = np.searchsorted(source, np.arange(len(blobs) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pd.DataFrame({"run": pdf["run"].to_numpy()[full], "blob": [_packed(keys[cuts[i] : cuts[i + 1]], size) for i in full]})


def _equal_windows(hashes: np.ndarray, place: np.ndarray, covered: np.ndarray, width: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of windows of `width` shingles: of each EVERY neighbours, the one of least hash. place: the words' documents; covered: starts that may count."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(hashes) - width + 1
    if n < 1:
        return none
    power, inverse = _power(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    whole = _mixed((sums[width:] - sums[:-width]) * inverse[:n], 6)
    span = width + shingle - 2
    fits = (place[:n] == place[span : span + n]) & covered[:n]
    keys = np.where(fits, (whole & ~_LOW) | np.arange(n, dtype=np.uint64), ~np.uint64(0))
    if n < EVERY:
        at = np.flatnonzero(fits)
    else:
        least = _least(keys, EVERY)
        at = np.unique((least[least != ~np.uint64(0)] & _LOW).astype(np.int64))
    return whole[at], at


def _send(pdf: pd.DataFrame, answers: pd.DataFrame, width: int, shingle: int, functions: int, size: int) -> pa.Table:
    """The run's holders of shared keys (function 0 and on), of equal windows (-1), and the shingles of its documents that hold any (-2: `first` to `last`).

    more: a holder's node, a document's digest. Sorted by function.
    """
    ids, texts = _texts(pdf, width + shingle - 1)
    shared = np.sort(np.concatenate([np.empty(0, np.uint64), *(_unpacked(b, size) for b in answers["blob"])]))
    rows, blobs = [(np.empty(0, np.int64),) * 6], []
    for begin, some in _chunks(texts) if len(shared) else ():
        hashes, place, _ = made = shingles_of(some, shingle)
        key, owner, function, first, last, node, digests = keys_of(some, width, shingle, functions, made)
        full = _cut(key, size)
        keep = shared[np.minimum(np.searchsorted(shared, full), len(shared) - 1)] == full
        if not keep.any():
            continue
        key, owner, function, first, last, node = (x[keep] for x in (full, owner, function, first, last, node))
        rows.append((key.view(np.int64), ids[begin + owner], function, first, last, node))
        start = np.searchsorted(place, np.arange(len(some)))
        # Equal passages lie in windows that the first hash shares.
        one = function == 0
        low, high = (start[owner] + first)[one], (start[owner] + last)[one] - width + 2
        covered = np.cumsum(np.bincount(low, minlength=len(hashes) + 1) - np.bincount(high, minlength=len(hashes) + 1))[: len(hashes)] > 0
        equal, at = _equal_windows(hashes, place, covered, width, shingle)
        doc = place[at]
        rows.append((equal.view(np.int64), ids[begin + doc], np.full(len(at), -1), at - start[doc], at - start[doc] + width - 1, np.zeros(len(at), np.int64)))
        docs = np.unique(owner)
        a, b = np.full(len(some), len(hashes)), np.zeros(len(some), np.int64)
        np.minimum.at(a, owner, first)
        np.maximum.at(b, owner, last)
        rows.append((np.zeros(len(docs), np.int64), ids[begin + docs], np.full(len(docs), -2), a[docs], b[docs], digests[docs]))
        half = (hashes >> np.uint64(32)).astype("<u4")
        blobs += [half[start[d] + a[d] : start[d] + b[d] + 1].tobytes() for d in docs.tolist()]
    columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
    # Each kind of rows by itself, so that those who read one skip the pages of the others.
    order = np.argsort(columns[2], kind="stable")
    pieces = blobs + [None] * (len(order) - len(blobs))
    return pa.table([*(pa.array(c[order], t) for c, t in zip(columns, _TYPES, strict=True)), pa.array(pieces, pa.binary())], names=_NAMES)


_NAMES = ["key", "id", "function", "first", "last", "more", "blob"]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def holders(docs: DataFrame, words: int, shingle: int, functions: int, run_bytes: int) -> DataFrame:
    """docs (id, text). (key, id, function, first, last, more, blob): see _send; places in shingles."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // run_bytes + 1)
    # Enough of a key that two different ones are seldom taken for one, however large the corpus.
    size = min(8, -(-(int(total).bit_length() + 10) // 8))
    width = words - shingle + 1
    dealt = docs.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)).cast("long")).groupBy("run")
    asked = dealt.applyInPandas(lambda pdf: _request(pdf, width, shingle, functions, runs, size), "part bigint, run bigint, blob binary, many binary")
    shared = asked.groupBy("part").applyInPandas(lambda pdf: _answer(pdf, size), "run bigint, blob binary")
    schema = "key bigint, id bigint, function int, first int, last int, more bigint, blob binary"
    return dealt.cogroup(shared.groupBy("run")).applyInArrow(lambda a, b: _send(a.to_pandas(), b.to_pandas(), width, shingle, functions, size), schema)


def _in_class(df: DataFrame, roots: DataFrame) -> DataFrame:
    found = roots.select(F.col("node").alias("id"), F.col("root").alias("__root"))
    return df.drop("class").join(found, "id", "left").withColumn("class", F.coalesce("__root", "id")).drop("__root")


def _divided(held: DataFrame) -> DataFrame:
    """The holders of keys that have several classes."""
    return held.join(held.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x < y").select("key"), "key")


def _candidates(held: DataFrame, round_: int, enough: int, width: int) -> DataFrame:
    """(a, b, a_first, a_last, b_first, b_last, diagonal): pairs of a holder and the root of its keys, with `enough` hashes or more whose windows meet in one interval of one diagonal."""
    order = F.col("id") if round_ == 0 else F.xxhash64("id", F.lit(round_))
    first = F.min(F.struct(order.alias("o"), F.col("id").alias("b"), F.col("class").alias("b_class"), F.col("first").alias("b_first"), F.col("last").alias("b_last"), F.col("node").alias("b_node")))
    root = held.groupBy("key").agg(first.alias("r")).select("key", "r.*").drop("o")
    met = held.join(root, "key").where(F.col("class") != F.col("b_class")).withColumn("diagonal", F.col("node") - F.col("b_node"))
    # What both windows hold, in places of a: too little of it, and no passage is in both.
    met = met.withColumns({"low": F.greatest(F.col("first"), F.col("b_first") + F.col("diagonal")), "high": F.least(F.col("last"), F.col("b_last") + F.col("diagonal"))})
    step = (width - DRIFT) // 2
    met = met.where(F.col("high") - F.col("low") + 1 >= 2 * step)
    # A cell is so small that whatever is long enough covers one. Cells of diagonals: two sets, half a step apart, so that neighbours are together in one.
    cells = F.sequence(F.ceil(F.col("low") / step), F.floor((F.col("high") + 1) / step) - 1)
    met = met.select(F.col("id").alias("a"), "b", "function", "low", "high", "diagonal", F.explode(cells).alias("cell"))
    ways = F.array(*(F.floor((F.col("diagonal") + i * DRIFT) / (2 * DRIFT)) * 2 + i for i in (0, 1)))
    met = met.select("*", F.explode(ways).alias("way"))
    shift = F.col("low") - F.col("diagonal"), F.col("high") - F.col("diagonal")
    edges = F.min("low").alias("a_first"), F.max("high").alias("a_last"), F.min(shift[0]).alias("b_first"), F.max(shift[1]).alias("b_last"), F.min("diagonal").alias("diagonal")
    agreed = met.groupBy("a", "b", "way", "cell").agg(F.bit_or(F.expr("shiftleft(1L, function)")).alias("mask"), *edges).where(F.bit_count("mask") >= enough)
    return agreed.groupBy("a", "b").agg(*(f(c).alias(c) for f, c in ((F.min, "a_first"), (F.max, "a_last"), (F.min, "b_first"), (F.max, "b_last"), (F.min, "diagonal"))))


def _on_diagonal(a: np.ndarray, b: np.ndarray, d: int, width: int, least: float) -> tuple[int, int, float] | None:
    """The window of a that has the most in common with b on the diagonal d, if that is enough."""
    low, high = max(0, d), min(len(a), len(b) + d)
    if high - low < width:
        return None
    sums = np.concatenate(([0], np.cumsum(a[low:high] == b[low - d : high - d])))
    full = sums[width:] - sums[:-width]
    i = int(full.argmax()) + low
    if full[i - low] * (1 + least) < 2 * width * least:
        return None
    one, two = set(a[i : i + width].tolist()), set(b[i - d : i - d + width].tolist())
    common = len(one & two)
    score = common / (len(one) + len(two) - common)
    return (i, i - d, score) if score >= least else None


def _different(values: np.ndarray, places: np.ndarray, width: int, n: int) -> np.ndarray:
    """How many different values stand in each of the first n windows of `width` places. A place may hold several."""
    key = np.sort((values << np.int64(32)) | places)
    value, last = key >> np.int64(32), key & np.int64(0xFFFFFFFF)
    # A value counts by its latest place in the window.
    first = last - width + 1
    same = np.flatnonzero(value[1:] == value[:-1])
    first[same] = np.maximum(first[same], 0)
    until = np.full(len(last), n - 1)
    until[same] = last[same + 1] - width
    first, until = np.maximum(first, 0), np.minimum(np.minimum(last, until), n - 1)
    fits = first <= until
    return np.cumsum(np.bincount(first[fits], minlength=n + 1) - np.bincount(until[fits] + 1, minlength=n + 1))[:n]


def _diagonals(lo: np.ndarray, sizes: np.ndarray, order: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """How many equal shingles each diagonal has (the first is that of b's end), about `most` of them looked at in one go."""
    out = np.zeros(len(sizes) + len(order), np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, side="right")) - 1)
        many = sizes[begin:end]
        at = np.repeat(np.arange(begin, end), many)
        nth = np.arange(len(at)) - np.repeat(total[begin:end] - total[begin], many)
        out += np.bincount(at - order[np.repeat(lo[begin:end], many) + nth] + len(order), minlength=len(out))
        begin = end
    return out


def verified_span(a: np.ndarray, b: np.ndarray, width: int, least: float) -> tuple[int, int, float] | None:
    """First places of `width` shingles of a and of b that are alike enough, and their similarity; None if there are none.

    On a diagonal, all windows are judged at once: what both have in common follows from how many different shingles each has and both together have.
    """
    if len(a) < width or len(b) < width:
        return None
    order = np.argsort(b, kind="stable")
    values = b[order]
    lo, hi = np.searchsorted(values, a), np.searchsorted(values, a, side="right")
    # As many different shingles as a similarity of `least` takes of each side.
    need = int(np.ceil(2 * width * least / (1 + least))) - 1
    dense = []
    for hit in (lo < hi, np.isin(b, a)):
        counts = np.concatenate(([0], np.cumsum(hit)))
        dense.append(counts[width:] - counts[:-width] >= need)
    if not (dense[0].any() and dense[1].any()):
        return None
    many = _diagonals(lo, hi - lo, order)
    # Diagonals, the fullest first, that have enough hits on them and a few places around.
    slack = width // 8
    sums = np.concatenate((np.zeros(slack + 1, np.int64), np.cumsum(many), np.full(slack, many.sum())))
    ways = np.flatnonzero((many > 0) & (sums[2 * slack + 1 :] - sums[: -2 * slack - 1] >= need))
    rank = np.unique(np.concatenate((a, b)), return_inverse=True)[1].astype(np.int64)
    x, y = rank[: len(a)], rank[len(a) :]
    n_a, n_b = (_different(v, np.arange(len(v)), width, len(v) - width + 1) for v in (x, y))
    for d in (ways[np.argsort(-many[ways], kind="stable")] - len(b)).tolist():
        low, high = max(0, d), min(len(a), len(b) + d)
        n = high - low - width + 1
        if n < 1:
            continue
        one, two = n_a[low : low + n], n_b[low - d : low - d + n]
        fits = dense[0][low : low + n] & dense[1][low - d : low - d + n] & (np.minimum(one, two) >= least * np.maximum(one, two))
        if not fits.any():
            continue
        at = np.flatnonzero(fits)
        # From the first window that may do to the last.
        begin, end = int(at[0]), int(at[-1]) + 1
        span = end - begin + width - 1
        place = np.arange(span)
        both = np.concatenate((x[low + begin : low + begin + span], y[low - d + begin : low - d + begin + span]))
        together = _different(both, np.concatenate((place, place)), width, end - begin)
        score = np.where(fits[begin:end], (one[begin:end] + two[begin:end] - together) / together, 0.0)
        best = int(score.argmax())
        if score[best] >= least:
            return low + begin + best, low - d + begin + best, float(score[best])
    return None


def _verify(batches: Iterable[pd.DataFrame], width: int, least: float) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            a, b = np.frombuffer(r.a_blob, "<u4"), np.frombuffer(r.b_blob, "<u4")
            # Most that are alike are so on the diagonal that they met on; the others take a search.
            found = _on_diagonal(a, b, int(r.diagonal - r.a_first + r.b_first), width, least) or verified_span(a, b, width, least)
            if found:
                out.append((r.a, r.b, r.a_first + found[0], r.b_first + found[1], found[2]))
        yield pd.DataFrame(out, columns=["a", "b", "a_word", "b_word", "similarity"])


def _cover(batches: Iterable[pd.DataFrame], width: int, enough: int) -> Iterator[pd.DataFrame]:
    """(id, class, first, starts, blob): the shingles from `first` on, and a bit for each, whether `width` from there hold nodes of `enough` functions."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            low, more, function = r.spots >> 32, r.spots >> 16 & 0xFFFF, r.spots & 0xFFFF
            low = low - r.first
            n = len(r.blob) // 4
            many = np.zeros(n, np.int64)
            for j in np.unique(function):
                one = function == j
                many += np.cumsum(np.bincount(low[one], minlength=n + 1) - np.bincount(low[one] + more[one] + 1, minlength=n + 1))[:n] > 0
            at = np.flatnonzero(many >= enough)
            if len(at):
                a, b = int(at[0]), int(at[-1]) + width
                out.append((r.id, r[1], r.first + a, np.packbits(many[a:b] >= enough).tobytes(), r.blob[4 * a : 4 * b]))
        yield pd.DataFrame(out, columns=["id", "class", "first", "starts", "blob"])


def _covered(blob: bytes, starts: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as numbers, the places where passages may begin, and whether each shingle lies in one."""
    hashes = np.frombuffer(blob, "<u4").astype(np.int64)
    at = np.flatnonzero(np.unpackbits(np.frombuffer(starts, np.uint8), count=len(hashes)))
    inside = np.cumsum(np.bincount(at, minlength=len(hashes) + 1) - np.bincount(at + width, minlength=len(hashes) + 1))[: len(hashes)] > 0
    return hashes, at, inside


def _shingles(batches: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """(shingle, id, class): what may lie in a passage, once for each document."""
    for pdf in batches:
        sets = []
        for r in pdf.itertuples(index=False):
            hashes, _, inside = _covered(r.blob, r.starts, width)
            sets.append(np.unique(hashes[inside]))
        sizes = [len(x) for x in sets]
        yield pd.DataFrame({"shingle": np.concatenate([np.empty(0, np.int64), *sets]), "id": np.repeat(pdf["id"].to_numpy(np.int64), sizes), "class": np.repeat(pdf["class"].to_numpy(np.int64), sizes)})


#: Marks of a place's shingle: among the first of some passage at all, if the other has no fewer shingles, and that with repeats in its own.
_WEAK, _STRONG, _THIN = 1, 2, 4


def first_shingles(hashes: np.ndarray, starts: np.ndarray, ranked: np.ndarray, width: int, least: float, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(place, marks) of shared shingles that come first in the windows of `width` that begin at `starts`.

    ranked: documents that have a shingle, times 2^32, and the shingle, for those that other classes have. They come last in this order. Windows of s and t
    different shingles, s no more than t, that are as alike as `least` have ceil(least * s') or more in common, with s' = t, and ceil(2 * least / (1 + least) * s)
    or more. All that comes before the first common one stands in one of the two only.
    """
    by = np.sort(ranked & 0xFFFFFFFF)
    order = ranked[np.argsort(ranked & 0xFFFFFFFF, kind="stable")]
    nth = np.minimum(np.searchsorted(by, hashes), len(by) - 1)
    hit = by[nth] == hashes
    code = np.where(hit, order[nth], -1 - hashes)
    # Windows that have enough shared ones to be like any other.
    n = len(hashes) - width + 1
    number = np.unique(code, return_inverse=True)[1].astype(np.int64)
    size, own = _different(number, np.arange(len(code)), width, n), _different(number[~hit], np.flatnonzero(~hit), width, n)
    need = lambda s, share: np.ceil(s * share - 1e-9).astype(np.int64)
    starts = starts[(size - own >= need(size, least))[starts]]
    marks = np.zeros(len(hashes), np.int64)
    for begin in range(0, len(starts), most):
        some = starts[begin : begin + most]
        window = np.lib.stride_tricks.sliding_window_view(code, width)[some]
        where = np.argsort(window, axis=1, kind="stable")
        values = np.take_along_axis(window, where, 1)
        new = np.ones(values.shape, bool)
        new[:, 1:] = values[:, 1:] != values[:, :-1]
        rank, s = np.cumsum(new, axis=1), size[some][:, None]
        weak = new & (values >= 0) & (rank <= s - need(s, least) + 1)
        strong = weak & (rank <= s - need(s, 2 * least / (1 + least)) + 1)
        row, column = np.nonzero(weak)
        mark = _WEAK + _STRONG * strong + _THIN * (strong & (s < width))
        np.bitwise_or.at(marks, some[row] + where[row, column], mark[row, column])
    place = np.flatnonzero(marks)
    return place, marks[place]


def _prefixes(batches: Iterable[pd.DataFrame], width: int, least: float) -> Iterator[pd.DataFrame]:
    """(shingle, around, id, class, place, low, high, marks): see first_shingles; around: a digest of all shingles that a passage with the place may have."""
    factors = _mixed(np.arange(2 * width - 1, dtype=np.uint64), 7) | np.uint64(1)
    names = ["shingle", "around", "id", "class", "place", "low", "high", "marks"]
    for pdf in batches:
        out = [np.empty((0, len(names)), np.int64)]
        for r in pdf.itertuples(index=False):
            hashes, starts, _ = _covered(r.blob, r.starts, width)
            place, marks = first_shingles(hashes, starts, np.asarray(r.ranked, np.int64), width, least)
            if len(place):
                # What lies beyond the ends differs from any shingle.
                padded = np.concatenate((np.zeros(width - 1, np.uint64), hashes.astype(np.uint64) + np.uint64(1), np.zeros(width - 1, np.uint64)))
                views = np.lib.stride_tricks.sliding_window_view(padded, 2 * width - 1)
                around = np.concatenate([_mixed((views[place[i : i + 4096]] * factors).sum(axis=1, dtype=np.uint64), 8) for i in range(0, len(place), 4096)])
                low, high = np.maximum(place - width + 1, 0), np.minimum(place + width - 1, len(hashes) - 1)
                same = np.ones(len(place), np.int64)
                out.append(np.column_stack((hashes[place], around.view(np.int64), same * r.id, same * r[1], place + r.first, low + r.first, high + r.first, marks)))
        yield pd.DataFrame(np.concatenate(out), columns=names)


def _rest(held: DataFrame, blobs: DataFrame, width: int, least: float, enough: int) -> DataFrame:
    """Pairs as _candidates has them: of the holders of divided keys, all of different classes that may have passages in common."""
    low = F.greatest(F.col("first"), F.col("node") - (width - 1))
    more = F.least(F.col("node"), F.col("last") - (width - 1)) - low
    spot = F.shiftleft(low.cast("long"), 32) + F.shiftleft(more.cast("long"), 16) + F.col("function")
    spots = held.groupBy("id").agg(F.min("class").alias("class"), F.collect_set(spot).alias("spots"))
    covers = spots.join(blobs, "id").select("id", "class", "first", "spots", "blob")
    covers = written(covers.mapInPandas(lambda x: _cover(x, width, enough), "id bigint, class bigint, first int, starts binary, blob binary"))
    has = covers.mapInPandas(lambda x: _shingles(x, width), "shingle bigint, id bigint, class bigint")
    shared = has.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where("x < y")
    ranked = has.join(shared, "shingle").groupBy("id").agg(F.collect_list(F.shiftleft("n", 32) + F.col("shingle")).alias("ranked"))
    schema = "shingle bigint, around bigint, id bigint, class bigint, place bigint, low bigint, high bigint, marks bigint"
    met = written(covers.join(ranked, "id").mapInPandas(lambda x: _prefixes(x, width, least), schema), covers)
    whom = F.struct("id", "class", "place", "low", "high")
    same = met.groupBy("shingle", "around").agg(F.min(whom).alias("r"), F.bit_or("marks").alias("marks"), F.min("class").alias("x"), F.max("class").alias("y"))
    one = same.select("shingle", "r", "marks")
    pairs = met.withColumn("p", whom).select("shingle", "around", "p").join(same.where("x < y").select("shingle", "around", "r"), ["shingle", "around"]).select("p", "r")
    other = one.select("shingle", F.col("r").alias("p"), F.col("marks").alias("p_marks"))
    both = F.col("marks").bitwiseAND(F.col("p_marks")).bitwiseAND(_STRONG) != 0
    thin = F.col("marks").bitwiseOR(F.col("p_marks")).bitwiseAND(_THIN) != 0
    pairs = pairs.where("p.class <> r.class").union(other.join(one, "shingle").where("p.class > r.class").where(both | thin).select("p", "r"))
    edges = F.min("p.low").alias("a_first"), F.max("p.high").alias("a_last"), F.min("r.low").alias("b_first"), F.max("r.high").alias("b_last")
    return pairs.groupBy(F.col("p.id").alias("a"), F.col("r.id").alias("b")).agg(*edges, F.min(F.col("p.place") - F.col("r.place")).alias("diagonal"))


def passage_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, shingle: int = SHINGLE, least: float = LEAST, functions: int = FUNCTIONS, enough: int = ENOUGH, run_bytes: int = RUN_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, a_word, b_word, similarity): links, with the words at which `words` alike ones begin in each; of whole copies, where they begin."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    width = words - shingle + 1
    found = written(holders(rows, words, shingle, functions, run_bytes))
    schema = "a bigint, b bigint, a_word bigint, b_word bigint, similarity double"
    link = lambda df, *c: df.select(F.col("id").alias("a"), "b", *(F.col(x).cast("long").alias(y) if isinstance(x, str) else x.alias(y) for x, y in zip(c, ("a_word", "b_word"), strict=True)), F.lit(1.0).alias("similarity"))
    # Copies are linked to the least of them, which alone goes on.
    texts = found.where("function = -2").select("id", F.col("more").alias("digest"))
    copies = written(texts.join(texts.groupBy("digest").agg(F.min("id").alias("b")), "digest").where("id > b"))
    start = F.lit(0).cast("long")
    links = [link(copies, start, start)]
    found = found.join(copies.select("id"), "id", "left_anti")
    # Equal windows: their holders go to the least of them.
    equal = found.where("function = -1").select("key", "id", "first")
    least_of = equal.select("id", "first", F.min(F.struct("id", "first")).over(Window.partitionBy("key")).alias("r"))
    pairs = least_of.select("id", "first", F.col("r.id").alias("b"), F.col("r.first").alias("b_first")).where("id > b").groupBy("id", "b").agg(F.min(F.struct("first", "b_first")).alias("w")).select("id", "b", "w.first", "w.b_first")
    links.append(written(link(pairs, "first", "b_first")))
    classes = connected_components(links[1].select("a", "b"))
    blobs = found.where("function = -2").select("id", "first", "blob")
    held = found.where("function >= 0").select("key", "id", "function", "first", "last", F.col("more").alias("node"))
    held = written(_divided(_in_class(held, classes)))
    piece = lambda c: F.substring("blob", ((F.col(f"{c}_first") - F.col("first")) * 4 + 1).cast("int"), ((F.col(f"{c}_last") - F.col(f"{c}_first") + 1) * 4).cast("int")).alias(f"{c}_blob")

    def alike(now: DataFrame) -> DataFrame:
        both = now.join(blobs.withColumnRenamed("id", "a"), "a").select(*now.columns, piece("a"))
        both = both.join(blobs.withColumnRenamed("id", "b"), "b").select("a", "b", "a_first", "b_first", "diagonal", "a_blob", piece("b"))
        return written(both.mapInPandas(lambda batches: _verify(batches, width, least), schema))

    tried = None
    for n in range(rounds):
        if held.isEmpty():
            break
        now = _candidates(held, n, enough, width)
        if tried is not None:
            now = now.join(tried.select("a", "b").union(tried.select("b", "a")), ["a", "b"], "left_anti")
        now = written(now)
        tried = now if tried is None else tried.unionByName(now)
        links.append(alike(now))
        if links[-1].isEmpty():
            break
        every = links[1]
        for more in links[2:]:
            every = every.union(more)
        classes = connected_components(every.select("a", "b"))
        held = written(_divided(_in_class(held, classes)), held)
    # Holders of divided keys that met no root like them, and pairs that were tried elsewhere only.
    if not held.isEmpty():
        links.append(alike(written(_rest(held, blobs, width, least, enough))))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, n_links, word, partner): the least id that links reach; of the first link, where it begins and with whom."""
    links = written(passage_links(docs, id_col, text_col, **options))
    roots = connected_components(links.select("a", "b"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("partner"), F.col("a_word").alias("word")).union(links.select("b", "a", "b_word"))
    counts = ends.groupBy("node").agg(F.count("*").alias("n_links"), F.min_by(F.struct("word", "partner"), F.struct("partner", "word")).alias("first"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    joined = ids.join(counts, ids["id"] == counts["node"], "left").drop("node").join(roots, F.col("id") == roots["node"], "left")
    return joined.select("id", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("first.word").alias("word"), F.col("first.partner").alias("partner"))


def report(docs: DataFrame) -> DataFrame:
    return passage_classes(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links", "word", F.col("partner").alias("partner_id"))
