"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols. The leaves of its tree hold the merge rank of
every adjacent pair (with the position below it in the same integer, so that the
least value is the leftmost of the lowest rank); the root names the next merge.
A merge changes two leaves and removes one, and only their paths to the root are
recomputed. Trees of equal size are worked in one numpy batch; long pre-tokens get
a tree of their own in plain Python.

The vocabulary file is a parameter and is read on each executor.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ringsight.llm.common import read

NONE = np.int64(1) << 62
POS = 20  # bits of the position
LONG = 256  # symbols from which a pre-token has a tree of its own
#: Entries of each of a worker cache's two generations.
CACHE_ENTRIES = 300_000
#: A character whose lower case, class or composition is left to the text's own path.
UNCOMMON = "[^\x00-\x1b -\x84\x86-\u012f\u0131-\u017f\u2010-\u2027\u20ac]"
#: The vocabulary's pre-tokens but for runs of letters, which stay between them.
APART = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t\n\x0b\f\r \x{a0}\p{L}\p{N}]+)"
#: Characters that Python counts as blank and the vocabulary's own pattern does not.
UNSURE = re.compile(r"[\x1c-\x1f]")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class MergeTable:
    """Pair -> rank and merged id, as a dict and as sorted arrays for batches."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        keys = np.array([(a << 32) | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        vals = np.array([*self.rank.values(), (0, 0)], np.int64)
        self.ranks, self.made = vals[:-1, 0][order], vals[:-1, 1][order]
        self.ranks, self.made = np.append(self.ranks, 0), np.append(self.made, 0)
        self.by_rank = np.zeros(len(pairs), np.int64)
        self.by_rank[vals[:-1, 0]] = vals[:-1, 1]

    def leaves(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Leaf values; negative ids stand for no symbol."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, (self.ranks[at] << POS) | pos, NONE)


def merge_batch(symbols: np.ndarray, table: MergeTable) -> np.ndarray:
    """Merge each row of a (words x power of two) matrix of ids padded with -1; merged-away places become -1."""
    ids = symbols.astype(np.int64)
    w, n = ids.shape
    rows, cols = np.arange(w), np.arange(n)
    nxt = np.where(np.roll(ids, -1, 1) >= 0, cols + 1, n)
    nxt[:, -1] = n
    prv = np.broadcast_to(cols - 1, (w, n)).copy()
    right = np.full((w, n), -1, np.int64)
    right[:, :-1] = ids[:, 1:]
    tree = np.full((w, 2 * n), NONE, np.int64)
    tree[:, n:] = table.leaves(ids, right, np.broadcast_to(cols, (w, n)))
    k = n
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2

    def put(at_row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + n
        tree[at_row, node] = value
        while n > 1 and node[0] > 1:  # leaves are on one level, so all reach the root together
            node = node >> 1
            tree[at_row, node] = np.minimum(tree[at_row, 2 * node], tree[at_row, 2 * node + 1])

    live = rows[tree[:, 1] < NONE]
    while len(live):
        top = tree[live, 1]
        i = top & ((1 << POS) - 1)
        j = nxt[live, i]
        ids[live, i] = table.by_rank[top >> POS]
        ids[live, j] = -1
        far = nxt[live, j]
        nxt[live, i] = far
        inner = far < n
        prv[live[inner], far[inner]] = i[inner]
        put(live, j, np.full(len(live), NONE))
        after = np.where(inner, ids[live, np.minimum(far, n - 1)], -1)
        put(live, i, table.leaves(ids[live, i], after, i))
        before = prv[live, i]
        has = before >= 0
        if has.any():
            r, b = live[has], before[has]
            put(r, b, table.leaves(ids[r, b], ids[r, i[has]], b))
        live = live[tree[live, 1] < NONE]
    return ids


def merge_long(symbols: list[int], table: MergeTable) -> list[int]:
    """The same for one pre-token of any length."""
    n, none, rank = len(symbols), (1 << 62, 0), table.rank
    size = 1
    while size < n:
        size *= 2
    ids, nxt, prv = list(map(int, symbols)), list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if hit := rank.get((ids[i], ids[i + 1])):
            tree[size + i] = (hit[0], i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    while size > 1 and tree[1] != none:
        r, i = tree[1]
        j = nxt[i]
        ids[i], ids[j] = int(table.by_rank[r]), -1
        nxt[i] = far = nxt[j]
        put(j, none)
        hit = rank.get((ids[i], ids[far])) if far < n else None
        if far < n:
            prv[far] = i
        put(i, (hit[0], i) if hit else none)
        if (b := prv[i]) >= 0:
            hit = rank.get((ids[b], ids[i]))
            put(b, (hit[0], b) if hit else none)
    return [x for x in ids if x >= 0]


def letters(upto: int = 0x250) -> tuple[str, str]:
    """Escaped character classes (letters, numbers) below ``upto``."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(upto)):
        if (k := unicodedata.category(c)[0]) in kinds:
            kinds[k].append(re.escape(c))
    return "".join(kinds["L"]), "".join(kinds["N"])


class WordBpe:
    """Encoder for the word-end vocabulary: NFC, blanks dropped, lower case, byte-level symbols, ``</w>`` ends a pre-token."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        self.table = MergeTable(self.vocab, model["merges"])
        self.alphabet = byte_alphabet()
        self.byte_ids = np.array([self.vocab[c] for c in self.alphabet], np.int64)
        self.end_ids = np.array([self.vocab[c + self.suffix] for c in self.alphabet], np.int64)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        let, num = letters()
        # chunks hold no blanks, so the pattern's last branch need not exclude them
        self.ascii = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{let}]+|[{num}]|[^{let}{num}]+")
        import regex

        self.wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")

    def pretokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without blanks or special strings."""
        if chunk.isascii():
            return self.ascii.findall(chunk.lower())
        text = "".join(c.lower() for c in unicodedata.normalize("NFC", chunk))
        return (self.wide if max(text) >= "ɐ" else self.ascii).findall(text)

    def encode_pretokens(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        out: list = [None] * len(words)
        for i in np.flatnonzero(sizes > LONG):
            symbols = np.append(self.byte_ids[np.frombuffer(raw[i][:-1], np.uint8)], self.end_ids[raw[i][-1]])
            out[i] = np.array(merge_long(symbols.tolist(), self.table), "<u4").tobytes()
        size = 2
        while size <= LONG:
            low = size // 2 + 1 if size > 2 else 1
            group = np.flatnonzero((sizes >= low) & (sizes <= size))
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                n = sizes[part]
                grid = np.frombuffer(b"".join([raw[i].ljust(size, b"\0") for i in part]), np.uint8).reshape(-1, size)
                ids = np.where(np.arange(size) < n[:, None], self.byte_ids[grid], -1)
                rows = np.arange(len(part))
                ids[rows, n - 1] = self.end_ids[grid[rows, n - 1]]
                ids = merge_batch(ids, self.table)
                kept = ids >= 0
                flat, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
                start = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[start:end]
                    start = end
            size *= 2
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens and of special strings, which stand behind a blank here: no pre-token holds one."""
        special = {w: np.array([self.special[w[1:]]], "<u4").tobytes() for w in words if w[0] == " "}
        if not special:
            return self.encode_pretokens(words)
        rest = [w for w in words if w not in special]
        made = special | dict(zip(rest, self.encode_pretokens(rest), strict=True))
        return [made[w] for w in words]

    def words(self, text: str) -> list[str]:
        """The words of ``encode_words`` of one text of any characters."""
        out = []
        for chunk in split_chunks(text):
            if "<|" in chunk and self.specials.search(chunk):
                for x in self.specials.split(chunk):
                    out += [" " + x] if x in self.special else self.pretokens(x) if x else []
            else:
                out += self.pretokens(chunk)
        return out

    def word_lists(self, texts: pa.Array) -> pa.ListArray:
        """``words`` of each text. Texts of common characters only, which nearly all are, are cut by Arrow's expressions."""
        slow = pc.or_(pc.match_substring_regex(texts, UNCOMMON), pc.match_substring(texts, "<|"))
        if not pc.any(slow).as_py():
            return self._cut(texts)
        where = np.flatnonzero(slow.to_numpy(zero_copy_only=False))
        made = pa.array([self.words(texts[int(i)].as_py()) for i in where], pa.list_(pa.string()))
        order = np.arange(len(texts))
        order[where] = len(texts) + np.arange(len(where))
        return pa.concat_arrays([self._cut(pc.if_else(slow, "", texts)), made]).take(pa.array(order))

    @staticmethod
    def _cut(texts: pa.Array) -> pa.ListArray:
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=APART, replacement=r" \1 ")
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(apart))  # at the end of its buffer a last blank may come back as a word
        flat = lists.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(full))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(full)))


class TextBpe:
    """Ids of blocks of texts; a cache of pre-tokens lives as long as the worker."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.cache = ChunkCache(self.bpe.encode_words)
        names = [""] * (1 + max(self.bpe.names))
        for i, x in self.bpe.names.items():
            names[i] = x
        #: As the library decodes without a decoder: the tokens' own strings, joined by one blank.
        self.names, self.numbers = pa.array(names, pa.string()), pa.array([str(i) for i in range(len(names))], pa.string())

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty) one after the other, and for each text where its own end."""
        texts = texts.cast(pa.string()).fill_null("")
        if len(texts) != 1:
            return self._ids(texts)
        flat = np.concatenate([self._ids(pa.array([x], pa.string()))[0] for x in pieces_of(texts[0].as_py())])
        return flat, np.array([len(flat)])

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self.bpe.word_lists(texts)
        coded = lists.flatten().dictionary_encode()
        made = list(next(self.cache.over([coded.dictionary.to_pylist()])))
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        pool, at = np.frombuffer(b"".join(made), "<u4"), coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        upto = np.append(0, np.cumsum(n))
        flat = pool[np.repeat((np.cumsum(sizes) - sizes)[at] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]

    def digests(self, ids: np.ndarray, ends: np.ndarray, names: pa.Array, most: int = 1 << 22) -> list[str]:
        """SHA-256 of each text's names joined by one blank. At most ``most`` names of a text are strings at a time."""
        out, start = [], 0
        if len(ids) <= most:
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), names.take(pa.array(ids)))
            return [hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(rows, " ").cast(pa.binary())]
        for end in ends.tolist():
            h = hashlib.sha256()
            for at in range(start, end, most):
                part = names.take(pa.array(ids[at : min(end, at + most)]))
                h.update(b" " if at > start else b"")
                h.update(" ".join(part.to_pylist()).encode())
            out.append(h.hexdigest())
            start = end
        return out


class ChunkCache:
    """Chunk -> what ``make`` gives for it, in two generations: when the young one is full it replaces the old one.

    Chunks in use are carried over, so what is dropped has not been seen for a
    while; memory stays bounded by twice ``most`` entries.
    """

    def __init__(self, make, most: int = CACHE_ENTRIES):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def over(self, pieces: list[list[str]]) -> Iterator[list]:
        """The values for each list of chunks; all misses are made together."""
        lack = set().union(*pieces).difference(self.young)
        if len(self.young) + len(lack) > self.most:
            self.young, self.old = {}, self.young
            lack = set().union(*pieces)
        again = lack & self.old.keys()
        self.young.update((c, self.old[c]) for c in again)
        new = list(lack - again)
        self.young.update(zip(new, self.make(new), strict=True))
        get = self.young.__getitem__
        for p in pieces:
            yield list(map(get, p))


def blocks(batch: pa.RecordBatch, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, base = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, end - at)
        at, base = end, int(sizes[end - 1])


@lru_cache(maxsize=2)
def text_bpe(path: str) -> TextBpe:
    return TextBpe(path)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def split_chunks(text: str) -> list[str]:
    """Runs without blanks. No pre-token spans a blank, so a text's ids are those of its runs one after the other."""
    if UNSURE.search(text):  # separators that Python alone counts as blank
        import regex

        return [c for c in regex.split(r"\p{White_Space}+", text) if c]
    return text.split()


def pieces_of(text: str, most: int = 2_000_000) -> list[str]:
    """The text cut behind blanks into pieces of about ``most`` characters; a run without blanks stays whole."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.rfind(" ", at, at + most) + 1 or text.find(" ", at + most) + 1 or len(text)
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text).

    Null text is empty; an empty text has no ids and the digests of the empty
    string. Other columns are ignored, repeated rows are encoded each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(path)
        for batch in batches:
            for part in blocks(batch):
                ids, ends = bpe.ids(part.column("text"))
                n = np.diff(ends, prepend=0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(bpe.digests(ids, ends, bpe.numbers)), pa.array(bpe.digests(ids, ends, bpe.names))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(read(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))
