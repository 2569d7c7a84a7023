"""Alignment of two tokenizers' tokens by their byte offsets.

A token list is turned into the list of the byte offsets where its tokens end. The ends that
both lists hold are found by galloping intersection: the shorter list drives, each of its ends
is sought in the longer one by steps that double and then by binary search between the last
two. The common ends cut both token lists into groups; a token is linked with every token of the other
list in its group, and the ranks of a token's two ends in the other list give the
range of tokens it overlaps.

A long text is cut first where both tokenizers surely end a token: at a border between pieces of
the split pattern of tokenizer A that no entry of B's vocabulary spans. Such stretches repeat, so
each different one is tokenized and intersected once. Texts in which such borders are not sure
(other scripts, several spaces, carriage returns, letters right behind a contraction) are one stretch.

Counts of linked id pairs over the corpus need no row per token: a task writes one row per
chunk of documents, with the chunk's different pairs and in how many of its documents each
occurs. Those are summed by pair, joined back to the chunks' pairs, and each chunk then adds up
its documents. A chunk is bounded by ``CHUNK`` pairs (or one document).

Defined cases: a null or empty text, and one whose tokens do not give back its bytes, has no
tokens; rows that repeat an id or a text are documents of their own, in the counts too; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, repeat
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankline.llm.common import table
from rankline.llm.tokens import NOT_PLAIN, PIECE

CHUNK = 2_000_000  # pairs of a chunk, counted once for each document that holds them
STRETCHES = 300_000  # different stretches that a worker keeps; beyond it all but the first half are learned anew
COUNTS = 5  # of a stretch: whether it has an alignment, tokens of A and of B, groups, links
NO_BORDER = re.compile(r"  |\r|'(?:[std]|re|ve|m|ll)[^\W\d_]")
PAIR = 1 << 24  # pair key: A id * PAIR + B id
SHORT = 12  # tokens of both lists up to which a worker remembers the shape of two lists of ends


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def common_ends(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int]]:
    """Indices in ``a`` and in ``b`` (both strictly ascending) of the numbers that both hold."""
    if len(a) > len(b):
        j, i = common_ends(b, a)
        return i, j
    at_a, at_b, low = [], [], 0
    for i, x in enumerate(a):
        step, high = 1, low
        while high < len(b) and b[high] < x:
            low, high, step = high + 1, high + step, step * 2
        high = min(high, len(b))
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if b[mid] < x else (low, mid)
        if low == len(b):
            break
        if b[low] == x:
            at_a.append(i)
            at_b.append(low)
            low += 1
    return at_a, at_b


def groups(ends_a: Sequence[int], ends_b: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(from and upto in a, from and upto in b) of each group of tokens between common ends."""
    at_a, at_b = common_ends(ends_a, ends_b)
    upto = [(i + 1, j + 1) for i, j in zip(at_a, at_b)]
    return [(i, m, j, n) for (i, j), (m, n) in zip([(0, 0), *upto], upto)]


class Shape:
    """What groups of tokens make of any ids: their digest and which tokens they link. The ids
    are named by their place in the list of both, those of ``a`` first. Only for short lists."""

    def __init__(self, found: list[tuple[int, int, int, int]]):
        _, n_a, _, n_b = found[-1]
        self.form = ";".join([",".join(["%d"] * (m - i)) + "|" + ",".join(["%d"] * (n - j)) for i, m, j, n in found])
        self.pick = itemgetter(*[x for i, m, j, n in found for x in (*range(i, m), *range(n_a + j, n_a + n))])
        links = [(x, y) for i, m, j, n in found for x in range(i, m) for y in range(j, n)]
        self.in_a, self.in_b = [x for x, _ in links], [y for _, y in links]
        self.counts = (1, n_a, n_b, len(found), len(links))


@lru_cache(maxsize=20_000)
def shape(ends_a: tuple[int, ...], ends_b: tuple[int, ...]) -> Shape:
    """Of the groups of short lists: different words mostly have ends that another word had."""
    return Shape(groups(ends_a, ends_b))


@lru_cache(maxsize=None)  # for numbers that add up to SHORT at most
def one_group(n_a: int, n_b: int) -> Shape:
    return Shape([(0, n_a, 0, n_b)])


class Decimals(dict):
    """Ids as decimal strings, at most one for each entry of a vocabulary."""

    def __missing__(self, i: int) -> str:
        self[i] = str(i)
        return self[i]


DECIMALS = Decimals()


def overlaps(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """For each token of a, the range (from, upto) of b's tokens that share a byte with it."""
    b = np.array(ends_b, dtype=np.int64)
    ends = np.array(ends_a, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first, last = np.searchsorted(b, starts, "right"), np.searchsorted(b, ends, "left")
    return list(zip(first.tolist(), np.minimum(last + 1, len(b)).tolist()))


class Alignment(NamedTuple):
    a: list[int]
    b: list[int]
    groups: list[tuple[int, int, int, int]]

    def digest(self) -> str:
        a, b = list(map(DECIMALS.__getitem__, self.a)), list(map(DECIMALS.__getitem__, self.b))
        if len(self.groups) == 1:
            return f"{','.join(a)}|{','.join(b)}"
        return ";".join([f"{','.join(a[i:m])}|{','.join(b[j:n])}" for i, m, j, n in self.groups])

    def links(self) -> tuple[list[int], list[int]]:
        """The linked pairs as keys, and how often each is linked. A key may come again."""
        if len(self.a) * len(self.b) <= 64 and len(self.groups) == 1:
            keys = [x * PAIR + y for x in self.a for y in self.b]
            return keys, [1] * len(keys)
        keys, times = [], []
        for i, m, j, n in self.groups:
            if (m - i) * (n - j) <= 64:
                keys += [x * PAIR + y for x in self.a[i:m] for y in self.b[j:n]]
                times += [1] * ((m - i) * (n - j))
            else:  # a large group: its different ids only
                ca, cb = Counter(self.a[i:m]), Counter(self.b[j:n])
                keys += [x * PAIR + y for x in ca for y in cb]
                times += [p * q for p in ca.values() for q in cb.values()]
        return keys, times


class Tokens(NamedTuple):
    """The ids of stretches one after the other, where each stretch starts (and the last one ends),
    and where each token ends within its stretch."""

    a: np.ndarray
    starts_a: np.ndarray
    b: np.ndarray
    starts_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


class Aligner:
    """Tokenizer A is byte-level BPE, B a sentencepiece model with byte fallback."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
        form = {b: chr(b) for b in shown}
        form |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in form)}
        byte = {c: b for b, c in form.items()}
        self.form = form
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.size_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        for i, x in self.bytes_a.items():
            self.size_a[i] = len(x)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.line_feed = self.b.encode("\n")  # its token comes last, what B puts first before it
        whole = [x for i, x in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # Borders are sure if no entry of B holds two kinds of characters, or white space but at its front.
        self.borders = not any(kind(x) != kind(y) for n in whole for x, y in zip(n.lstrip("▁"), n.lstrip("▁")[1:]) if not NOT_PLAIN.search(x + y)) \
            and not any("▁" in n.lstrip("▁") or (len(n) > 1 and re.search(r"[\t-\f ]", n)) for n in whole)

    def stretches(self, text: str) -> list[str] | None:
        """Cuts space + text where both tokenizers end a token; None: no cut is sure."""
        text = " " + text
        return PIECE.findall(text) if self.borders and not NOT_PLAIN.search(text) and not NO_BORDER.search(text) else None

    def align(self, text: str) -> Alignment | None:
        """The alignment of a whole text; None if the tokens of A or B do not give back its bytes."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        return self.aligned(a, self.b.encode(text), (" " + text).encode("utf-8", "surrogatepass"))

    def align_stretches(self, found: list[str]) -> Iterator[Alignment | None]:
        """The alignments of stretches as they are, without a space before them. (Byte-level BPE
        always gives back the bytes of a stretch, B's tokens are checked.)"""
        for s, b in zip(found, self.b.encode(["\n" + s for s in found], num_threads=1)):
            raw = s.encode()
            a = [t.id for t in self.a.model.tokenize(raw.decode("latin-1").translate(self.form))]
            del b[:len(self.line_feed)]
            if b"".join([self.bytes_b[i] for i in b]) != raw:
                yield None
            else:
                yield Alignment(a, b, groups(self.size_a[a].cumsum().tolist(), self.size_b[b].cumsum().tolist()))

    def tokenize_stretches(self, found: list[str]) -> Tokens | None:
        """The tokens of stretches without line feeds, tokenized by B as the lines of one text: a
        line feed is a byte token, and nothing behind it depends on what is before it. None if B's
        tokens do not give back that text."""
        lines = "\n" + "\n".join(found)
        raw = lines.encode()
        b = self.b.encode(lines)[len(self.line_feed) - 1:]
        if b"".join([self.bytes_b[i] for i in b]) != raw or b.count(self.line_feed[-1]) != len(found):
            return None
        tokenize = self.a.model.tokenize
        in_a = [[t.id for t in tokenize(x)] for x in raw[1:].decode("latin-1").translate(self.form).split(self.form[10])]
        a = np.array([i for x in in_a for i in x], dtype=np.int64)
        b = np.array(b, dtype=np.int64)
        feeds = np.flatnonzero(b == self.line_feed[-1])
        starts_b = feeds - np.arange(len(feeds))
        b = np.delete(b, feeds)
        starts_a = np.cumsum([0, *map(len, in_a)])
        return Tokens(a, starts_a, b, np.append(starts_b, len(b)), ends_within(self.size_a[a], starts_a[:-1]), ends_within(self.size_b[b], starts_b))

    def aligned(self, a: list[int], b: list[int], raw: bytes) -> Alignment | None:
        in_a, in_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(in_a) != raw or b"".join(in_b) != raw or not all(in_a) or not all(in_b):
            return None
        return Alignment(a, b, groups(ends(in_a), ends(in_b)))

    def whole(self, text: str | None) -> Alignment:
        """The alignment of a whole text, without stretches."""
        return (self.align(text) if text else None) or Alignment([], [], [])


def kind(c: str) -> int:
    return 0 if c.isalpha() else 1 if c.isdigit() else 2


def ends_within(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of sizes that begin anew at each of the ascending starts."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return upto[1:] - np.repeat(upto[starts], np.diff(np.append(starts, len(sizes))))


def ends(parts: list[bytes]) -> list[int]:
    return list(accumulate(map(len, parts)))


@lru_cache(maxsize=1)
def aligner(paths: tuple[str, str] | None = None) -> Aligner:
    gc.set_threshold(200_000, 50, 50)  # a worker's many short lists hold no cycles
    return Aligner(*(paths or tokenizer_paths()))


class Numbers:
    """A growing array of longs."""

    def __init__(self):
        self.held, self.size = np.empty(1 << 16, dtype=np.int64), 0

    def extend(self, x: list[int] | np.ndarray) -> None:
        while self.size + len(x) > len(self.held):
            self.held = np.concatenate([self.held, np.empty_like(self.held)])
        self.held[self.size:self.size + len(x)] = x
        self.size += len(x)


class Chunk:
    """Stretches and documents since the last chunk row. A stretch has a number, under which
    its links (runs of ``keys`` and ``times``) and its counts are kept."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.index: dict[str, int] = {}
        self.digests: list[str] = []
        self.keys, self.times, self.starts, self.counts = Numbers(), Numbers(), Numbers(), Numbers()
        self.starts.extend([0])
        self.clear()

    def forget(self, keep: int) -> None:
        """Drops all but the first ``keep`` stretches, which are mostly the frequent ones."""
        gone = [s for s, i in self.index.items() if i >= keep]
        for s in gone:
            del self.index[s]
        del self.digests[keep:]
        self.starts.size = keep + 1
        self.keys.size = self.times.size = int(self.starts.held[keep])
        self.counts.size = keep * COUNTS

    def clear(self) -> None:
        self.docs, self.pairs, self.n_pairs = [], [], 0

    def learn(self, found: list[Alignment | None]) -> int:
        """Numbers the stretches; returns the first number."""
        first, at = self.starts.size - 1, self.keys.size
        keys: list[int] = []
        times: list[int] = []
        starts: list[int] = []
        counts: list[int] = []
        for x in found:
            if x:
                k, t = x.links()
                keys += k
                times += t
                counts += (1, len(x.a), len(x.b), len(x.groups), sum(t))
            else:
                counts += (0, 0, 0, 0, 0)
            starts.append(at + len(keys))
        for held, x in ((self.keys, keys), (self.times, times), (self.starts, starts), (self.counts, counts)):
            held.extend(x)
        self.digests += [x.digest() if x else "" for x in found]
        return first

    def learn_stretches(self, new: list[str]) -> None:
        """Numbers stretches that have no number yet."""
        lines = [s for s in new if "\n" not in s]
        made = self.aligner.tokenize_stretches(lines) if lines else None
        long = self.learn_short(lines, made) if made else lines
        rest = [*long, *[s for s in new if "\n" in s]] if len(long) or len(lines) < len(new) else []
        if rest:
            first = self.learn(list(self.aligner.align_stretches(rest)))
            self.index.update(zip(rest, range(first, first + len(rest))))

    def learn_short(self, found: list[str], made: Tokens) -> list[str]:
        """Numbers the stretches of at most ``SHORT`` tokens; returns the others."""
        a, b, ends_a, ends_b = made.a.tolist(), made.b.tolist(), made.ends_a.tolist(), made.ends_b.tolist()
        starts_a, starts_b = made.starts_a.tolist(), made.starts_b.tolist()
        shapes, digests, places, long = [], [], [], []
        for place, (i, m, j, n) in enumerate(zip(starts_a, starts_a[1:], starts_b, starts_b[1:])):
            if m - i + n - j > SHORT:
                long.append(found[place])
                continue
            x = one_group(m - i, n - j) if m - i == 1 or n - j == 1 else shape(tuple(ends_a[i:m]), tuple(ends_b[j:n]))
            shapes.append(x)
            digests.append(x.form % x.pick(a[i:m] + b[j:n]))
            places.append(place)
        counts = np.array([x.counts for x in shapes], dtype=np.int64).reshape(-1, COUNTS)
        links, at = counts[:, -1], np.array(places, dtype=np.int64)
        total = int(links.sum())
        in_a = np.fromiter(chain.from_iterable([x.in_a for x in shapes]), np.int64, total) + np.repeat(made.starts_a[at], links)
        in_b = np.fromiter(chain.from_iterable([x.in_b for x in shapes]), np.int64, total) + np.repeat(made.starts_b[at], links)
        first, size = self.starts.size - 1, self.keys.size
        self.keys.extend(made.a[in_a] * PAIR + made.b[in_b])
        self.times.extend(np.ones(total, dtype=np.int64))
        self.starts.extend(size + np.cumsum(links))
        self.counts.extend(counts.ravel())
        self.digests += digests
        self.index.update(zip([found[k] for k in places] if long else found, range(first, first + len(places))))
        return long

    def links(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in ``keys`` of the links of some stretches, and how many each has."""
        lo, hi = self.starts.held[codes], self.starts.held[codes + 1]
        n = hi - lo
        return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), n

    def full(self, stretches: int, size: int) -> bool:
        return self.starts.size > stretches or self.keys.size >= 2 * size

    def add(self, doc_id: int | None, text: str | None) -> None:
        cut = self.aligner.stretches(text) if text else []
        if cut is None:  # the whole text is one stretch
            found = self.aligner.align(text)
            codes, uses = np.array([self.learn([found])]), np.array([1])
            digest, self.digests[-1] = self.digests[-1], ""  # of no further use
        else:
            seen = Counter(cut)
            codes = np.fromiter(map(self.index.get, seen, repeat(-1)), dtype=np.int64, count=len(seen))
            unknown = np.flatnonzero(codes < 0)
            if len(unknown):
                names = list(seen)
                new = [names[k] for k in unknown.tolist()]
                self.learn_stretches(new)
                codes[unknown] = list(map(self.index.__getitem__, new))
            uses = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
            of = dict(zip(seen, map(self.digests.__getitem__, codes.tolist())))
            digest = ";".join(map(of.__getitem__, cut))
        counts = self.counts.held[:self.counts.size].reshape(-1, COUNTS)[codes]
        if not len(codes) or not counts[:, 0].all():
            self.docs.append((doc_id, 0, 0, 0, 0, "", codes[:0], uses[:0]))
            return
        self.docs.append((doc_id, *(uses @ counts)[1:].tolist(), hashlib.sha256(digest.encode()).hexdigest(), codes, uses))
        self.pairs.append(np.unique(self.keys.held[self.links(codes)[0]]))
        self.n_pairs += len(self.pairs[-1])

    def row(self, chunk: int) -> pa.RecordBatch:
        """The chunk as one row. Stretches are numbered anew, pairs are named by their place."""
        none = np.empty(0, dtype=np.int64)
        sizes = [len(d[6]) for d in self.docs]
        used, codes = np.unique(np.concatenate([none, *(d[6] for d in self.docs)]), return_inverse=True)
        pairs, docs = np.unique(np.concatenate([none, *self.pairs]), return_counts=True)
        at, lengths = self.links(used)
        keys, times = self.keys.held[at], self.times.held[at]

        def packed(x: list | np.ndarray) -> pa.Array:
            return pa.array([pa.compress(np.asarray(x, dtype="<u4").tobytes(), codec="zstd", asbytes=True)], pa.binary())

        one = lambda x, kind: pa.array([x], pa.list_(kind))
        columns = {"chunk": pa.array([chunk], pa.int64()), "pairs": one(pairs, pa.int64()), "docs": one(docs, pa.int64())}
        for k, name in enumerate(("doc_id", "n_a", "n_b", "n_groups", "n_links")):
            columns[name] = one([d[k] for d in self.docs], pa.int64())
        columns["groups_sha256"] = one([d[5] for d in self.docs], pa.string())
        for name, x in (("lengths", lengths), ("places", np.searchsorted(pairs, keys)), ("times", times),
                        ("sizes", sizes), ("codes", codes), ("uses", np.concatenate([none, *(d[7] for d in self.docs)]))):
            columns[name] = pa.StructArray.from_arrays([pa.array([len(x)], pa.int64()), packed(x)], ["n", "raw"])
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


PACKED = ("lengths", "places", "times", "sizes", "codes", "uses")
CHUNK_SCHEMA = "chunk long, pairs array<long>, docs array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, " \
    "n_links array<long>, groups_sha256 array<string>, " + ", ".join(f"{x} struct<n: long, raw: binary>" for x in PACKED)


def chunks(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = CHUNK, stretches: int = STRETCHES) -> DataFrame:
    """One row per chunk of documents, see ``Chunk.row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        held = Chunk(aligner(paths))
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.add(doc_id, text.as_py())
                if held.n_pairs >= size or held.full(stretches, size):
                    yield held.row(base + n)
                    n += 1
                    held.clear()
                    if held.full(stretches, size):
                        held.forget(min(stretches // 2, held.starts.size - 1) if held.starts.size > stretches else 0)
        if held.docs:
            yield held.row(base + n)

    return docs.select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair of ids is linked, and whether no pair
    with its A id is linked in more."""
    pairs = made.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    counts = table(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "counts").withColumn("a", F.floor(F.col("pair") / PAIR))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most a row per entry of A's vocabulary
    return counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def summaries(docs: DataFrame, paths: tuple[str, str] | None = None, size: int = CHUNK, stretches: int = STRETCHES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = table(chunks(docs, paths, size, stretches), "chunks")
    scored = made.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(made), "pair")
    scored = scored.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", (2 * F.col("n") + F.col("best").cast("long")).alias("v")))).alias("s"))
    scored = scored.select("chunk", F.col("s.v").alias("scores"))
    joined = made.drop("pairs", "docs").join(scored, "chunk", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda name: b.column(name)[row]
                x = {k: np.frombuffer(pa.decompress(get(k)["raw"].as_buffer(), decompressed_size=4 * get(k)["n"].as_py(), codec="zstd"), dtype="<u4") for k in PACKED}
                scores = np.array(get("scores").values if get("scores").is_valid else [], dtype=np.int64)
                at, times = x["places"], x["times"].astype(np.int64)
                per = [_sums(v[at] * times, x["lengths"])[x["codes"]] * x["uses"] for v in (scores & 1, scores >> 1)]
                n_best, count_sum = (_sums(v, x["sizes"]) for v in per)
                yield pa.RecordBatch.from_arrays(
                    [*(get(k).values for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), get("groups_sha256").values],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over runs of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    last = np.cumsum(lengths, dtype=np.int64)
    return upto[last] - upto[last - lengths]


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The alignment itself, per document: doc_id, a and b (ids), a_ends and b_ends (byte offsets in
    space + text), groups (ranges of both) and overlaps (for each token of a, its range in b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(paths)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = made.whole(text.as_py())
                at_a, at_b = ends([made.bytes_a[i] for i in x.a]), ends([made.bytes_b[i] for i in x.b])
                row = {"doc_id": doc_id, "a": x.a, "b": x.b, "a_ends": at_a, "b_ends": at_b,
                       "groups": [dict(zip(("a_from", "a_upto", "b_from", "b_upto"), g)) for g in x.groups],
                       "overlaps": [dict(zip(("b_from", "b_upto"), r)) for r in overlaps(at_a, at_b)]}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    place = lambda *names: pa.list_(pa.struct([(x, pa.int64()) for x in names]))
    numbers = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("a", numbers), ("b", numbers), ("a_ends", numbers), ("b_ends", numbers),
                        ("groups", place("a_from", "a_upto", "b_from", "b_upto")), ("overlaps", place("b_from", "b_upto"))])
    return docs.select("doc_id", "text").mapInArrow(run, """doc_id long, a array<long>, b array<long>, a_ends array<long>, b_ends array<long>,
        groups array<struct<a_from: long, a_upto: long, b_from: long, b_upto: long>>, overlaps array<struct<b_from: long, b_upto: long>>""")
