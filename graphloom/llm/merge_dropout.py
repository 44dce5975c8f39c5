"""Merge-type encoding with a SentencePiece vocabulary and seeded merge dropout.

Each word is a list of symbols with an agenda of candidate merges, best score
first, then leftmost.  A candidate whose keyed hash falls under `dropout` is skipped
when it comes up; it may come again only as a new candidate of changed neighbours.
The key is made of seed, document, occurrence (the how manieth word of its
document), place and piece, so each occurrence of a word is cut by draws of its
own, and a task that runs again gives the same ids.  With dropout 0 this is the
model's own segmentation.

What an agenda comes to depends on which candidates are skipped, so each word has
a tree of such decisions: a chain of merges down to its ids, and a branch wherever
a candidate was skipped by some occurrence.  All occurrences of a block of texts
walk down the trees side by side; branches that nobody took before are cut by
agendas that run side by side too.

Spaces become the model's space mark, before the text too; a mark that the text
has itself, and characters without a piece, go as bytes.  Decoding gives the text
back exactly, which each row reports.

Rules: a null text is empty and has no pieces; long texts and long words are
encoded whole; repeated rows come back once each and are cut alike; a null id is a
document of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import sparkkit, textkit

MARK = "▁"
#: Decisions that a task keeps before it starts its trees afresh.
KEPT = 5_000_000
#: Longest word that gets a tree; longer ones are cut one by one.
TREE_WORD = 64
_PLACE, _OCCURRENCE, _ALL = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, (1 << 64) - 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes, self.raw = [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.rank[piece] = (-sp.get_score(i), i)
                self.raw.append(piece.replace(MARK, " ").encode())
        inner = re.compile(f"[^{MARK}]{MARK}")
        if any(inner.search(p) for p in self.rank) or any("\n" in p for p in self.rank):
            raise ValueError("the model has pieces over several words")

    def cut(self, word: str, key: int, dropout: float) -> list[int]:
        """Ids of one word, given with its space marks; key is that of its occurrence."""
        n = len(word)
        symbols: list[str | None] = list(word)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, agenda = self.rank, []
        bar = int(dropout * (1 << 64))

        def offer(i: int, j: int) -> None:
            got = rank.get(symbols[i] + symbols[j])
            if got:
                heapq.heappush(agenda, (got[0], i, j, got[1], len(symbols[i]) + len(symbols[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, piece, size = heapq.heappop(agenda)
            if symbols[i] is None or symbols[j] is None or right[i] != j or len(symbols[i]) + len(symbols[j]) != size:
                continue
            if bar and draw(key, i, piece) < bar:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        out = []
        for s in symbols:
            if s is not None:
                got = rank.get(s)
                if got:
                    out.append(got[1])
                else:
                    out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space mark before it goes."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def draw(key: int, place: int, piece: int) -> int:
    """The keyed hash of one candidate merge of an occurrence."""
    h = key ^ (place * _PLACE & _ALL) ^ (piece << 40)
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & _ALL
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & _ALL
    return h ^ (h >> 33)


def occurrence_keys(document: int, seed: int, count: int) -> np.ndarray:
    """Keys of a document's words, by their places."""
    start = np.uint64((document ^ seed * 0xA0761D6478BD642F) & _ALL)
    return textkit.mix(start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_OCCURRENCE))


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(self.n, len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Encodes many texts with one seed; words are cut thousands at a time."""

    def __init__(self, vocabulary: Vocabulary, seed: int, dropout: float):
        self.vocabulary, self.seed, self.dropout = vocabulary, seed, dropout
        self.bar = min(int(dropout * (1 << 64)), _ALL)
        # the agenda's candidates as a hash table: which pairs of symbols join to which piece
        chars = {c for p in vocabulary.rank for c in p}
        self.symbol = {p: i for i, p in enumerate([*vocabulary.rank, *(c for c in sorted(chars) if c not in vocabulary.rank)])}
        self.ids = np.array([vocabulary.rank[p][1] if p in vocabulary.rank else -1 for p in self.symbol], np.int32)
        self.score = np.array([vocabulary.rank[p][0] if p in vocabulary.rank else np.inf for p in self.symbol], np.float32)
        self.of_code = np.full(0x110000, -2, np.int32)
        for c in chars:
            self.of_code[ord(c)] = self.symbol[c]
        pairs = sorted((self.symbol[p[:k]] * len(self.symbol) + self.symbol[p[k:]], self.symbol[p]) for p in vocabulary.rank for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol)
        self._hashed(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        self.mark = [vocabulary.bytes[b] for b in MARK.encode()]
        self.forget()

    def forget(self) -> None:
        """Start the trees afresh: nodes are decisions, a chain's nodes lie in a row and its last one (place -1) is its end."""
        self.root: dict[str, int] = {}
        self.place, self.piece, self.skip, self.chain = (_Grown(np.int32) for _ in range(4))
        self.term = _Grown(np.uint64)  # what place and piece give to a draw
        self.depth = _Grown(np.int32)  # merges before a node
        self.words: list[str] = []  # of each chain, with what it skips
        self.skips: list[tuple[int, ...]] = []
        self.start, self.size, self.flat = _Grown(np.int64), _Grown(np.int32), _Grown(np.int32)  # the ids of each chain

    def _hashed(self, keys: np.ndarray, joined: np.ndarray) -> None:
        """Fill the table of pairs: each lies at the first free place from its own on."""
        self.slots = 1 << int(np.ceil(np.log2(8 * len(keys))))
        self.keys, self.joined, self.far = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32), 0
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several, the last stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) % self.slots
            self.far += 1
        self.joined[at] = joined

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x1E3779B97F4A7C15 >> 20) & (self.slots - 1)

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (infinite where there is none) and joined symbols of pairs."""
        key = a.astype(np.int64) * len(self.symbol) + b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        found = self.keys[at]
        look = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.far - 1):
            if not len(look):
                break
            at[look] = (at[look] + 1) % self.slots
            found[look] = self.keys[at[look]]
            look = look[(found[look] != key[look]) & (found[look] >= 0)]
        hit = found == key
        piece = np.where(hit, self.joined[at], 0)
        return np.where(hit, self.score[piece], np.float32(np.inf)), piece

    def _agendas(self, words: list[str], skips: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cut words, each without the merges that it skips: the number of ids of each, all ids, and (word, place, piece) of all merges in order."""
        n, length = len(words), np.array([len(w) for w in words])
        wide = int(length.max()) + 1  # the last column stays empty
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        filled = (np.arange(wide)[None, :] < length[:, None]).ravel()
        sym = np.full(n * wide, -1, np.int32)
        sym[filled] = self.of_code[codes]
        code = np.zeros(n * wide, np.int32)
        code[filled] = codes
        score, piece = self._candidates(sym, np.append(sym[1:], -1))
        after = np.tile(np.arange(1, wide + 1, dtype=np.int32), n)
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), n)
        most = max(map(len, skips))
        skipped = np.array([(*s, *(-1,) * (most - len(s))) for s in skips], np.int64).reshape(n, most)
        live, made = np.arange(n), []
        table = score.reshape(n, wide)
        while len(live):
            at = (table if len(live) == n else table[live]).argmin(1)
            cell = live * wide + at
            open_ = np.isfinite(score[cell])
            live, at, cell = live[open_], at[open_], cell[open_]
            rows = live
            if most and len(rows):
                skip = (skipped[rows] == (at << 32 | self.ids[piece[cell]])[:, None]).any(1)
                score[cell[skip]] = np.inf
                rows, at, cell = rows[~skip], at[~skip], cell[~skip]
            if not len(rows):
                continue
            new, base = piece[cell], rows * wide
            made.append((rows, at, self.ids[new]))
            gone = base + after[cell]
            sym[cell], sym[gone], score[gone] = new, -1, np.inf
            then = after[gone]
            after[cell] = then
            past = base + np.minimum(then, wide - 1)
            before[past] = at
            score[cell], piece[cell] = self._candidates(new, np.where(then < wide, sym[past], -1))
            has = before[cell] >= 0
            cell, new = (base + before[cell])[has], new[has]
            score[cell], piece[cell] = self._candidates(sym[cell], new)
        kept = np.flatnonzero(filled & (sym != -1))
        own = np.where(sym[kept] >= 0, self.ids[np.maximum(sym[kept], 0)], -1)
        size = np.bincount(kept // wide, minlength=n)
        odd = np.flatnonzero(own < 0)
        if len(odd):  # characters without a piece go as bytes
            parts = [[self.vocabulary.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in code[kept[odd]].tolist()]
            count = np.ones(len(own), np.int64)
            count[odd] = [len(p) for p in parts]
            size = np.bincount(kept // wide, weights=count, minlength=n).astype(np.int64)
            first = np.cumsum(count) - count
            out = np.repeat(own, count)
            for at, p in zip(first[odd].tolist(), parts, strict=True):
                out[at : at + len(p)] = p
            own = out
        if not made:
            return size, own.astype(np.int32), *(np.empty(0, np.int64) for _ in range(3))
        rows, places, pieces = (np.concatenate(x) for x in zip(*made, strict=True))
        order = np.argsort(rows, kind="stable")
        return size, own.astype(np.int32), rows[order], places[order], pieces[order]

    def _chains(self, words: list[str], skips: list[tuple[int, ...]], depths: np.ndarray) -> np.ndarray:
        """New chains of words that skip some merges, from the merge at their depth on: their first nodes."""
        heads = np.empty(len(words), np.int64)
        lengths = np.array(list(map(len, words)))
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.searchsorted(lengths[order], range(5, TREE_WORD, 4))):
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000].tolist()
                size, ids, rows, places, pieces = self._agendas([words[i] for i in part], [skips[i] for i in part])
                nth = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(part)))[rows]
                depth = depths[part]
                new = nth >= depth[rows]
                rows, places, pieces, nth = rows[new], places[new], pieces[new], nth[new]
                count = np.bincount(rows, minlength=len(part))
                first = np.cumsum(count + 1) - count - 1  # each chain has an end besides
                nodes = int((count + 1).sum())
                where = first[rows] + nth - depth[rows]
                place, piece = np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
                place[where], piece[where] = places, pieces
                self.depth.add(np.repeat(depth - first, count + 1) + np.arange(nodes))
                self.chain.add(np.repeat(np.arange(len(part)) + len(self.words), count + 1))
                heads[part] = first + self.place.n
                self.place.add(place)
                self.piece.add(piece)
                self.term.add(place.astype(np.uint64) * np.uint64(_PLACE) ^ piece.astype(np.uint64) << np.uint64(40))
                self.skip.add(np.where(place < 0, -2, -1))
                self.start.add(np.cumsum(size) - size + self.flat.n)
                self.size.add(size)
                self.flat.add(ids)
                self.words += [words[i] for i in part]
                self.skips += [skips[i] for i in part]
        return heads

    def _branch(self, nodes: np.ndarray) -> None:
        """Make the chains of what follows where these nodes' merges are skipped."""
        chain, place, piece = self.chain.data[nodes].tolist(), self.place.data[nodes].tolist(), self.piece.data[nodes].tolist()
        skips = [(*self.skips[c], p << 32 | k) for c, p, k in zip(chain, place, piece, strict=True)]
        self.skip.data[nodes] = self._chains([self.words[c] for c in chain], skips, self.depth.data[nodes])

    def cut_token(self, token: str, key: int) -> list[int]:
        """Ids of any one token (a word with the spaces before it), without trees; the text's own marks go as bytes."""
        out: list[int] = []
        for i, part in enumerate(token.split(MARK)):
            out += (self.mark if i else []) + self.vocabulary.cut(part.replace(" ", MARK), key, self.dropout)
        return out

    def tokens(self, text: str) -> list[str]:
        """A text as words with the spaces before them, and line breaks."""
        if not text:
            return []
        text = " " + text
        if "  " in text or "\0" in text:
            return re.findall(r"\n| +[^ \n]*|[^ \n]+", text)
        return [t for t in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if t]

    def encode_all(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of each text; documents are 64-bit keys of the documents."""
        if self.place.n > KEPT:
            self.forget()
        cut = [self.tokens(t) for t in texts]
        every = [t for c in cut for t in c]
        new = list(set(every).difference(self.root))
        trees = [t for t in new if len(t) <= TREE_WORD and MARK not in t]
        self.root.update(dict.fromkeys(new, -1))
        if trees:
            self.root.update(zip(trees, self._chains([t.replace(" ", MARK) for t in trees], [()] * len(trees), np.zeros(len(trees), np.int64)).tolist(), strict=True))
        counts = [len(c) for c in cut]
        cur = np.array(list(map(self.root.__getitem__, every)), np.int64)
        keys = np.concatenate([occurrence_keys(d, self.seed, n) for d, n in zip(documents, counts, strict=True)]) if counts else np.empty(0, np.uint64)
        alone = np.flatnonzero(cur < 0)
        live = np.flatnonzero(cur >= 0) if self.bar else np.empty(0, np.int64)
        while len(live):
            node = cur[live]
            branch = self.skip.data[node]
            open_ = branch != -2
            live, node, branch = live[open_], node[open_], branch[open_]
            skip = textkit.mix(keys[live] ^ self.term.data[node]) < np.uint64(self.bar)
            missing = np.unique(node[skip & (branch < 0)])
            if len(missing):
                self._branch(missing)
                branch = self.skip.data[node]
            cur[live] = np.where(skip, branch, node + 1)
        chain = np.where(cur >= 0, self.chain.data[cur], 0)
        start, size = self.start.data[chain], self.size.data[chain].astype(np.int64)
        flat = self.flat.data[: self.flat.n]
        if len(alone):  # their ids go behind the others', for this call only
            own = [self.cut_token(every[i], int(keys[i])) for i in alone.tolist()]
            size[alone] = [len(x) for x in own]
            start[alone] = np.cumsum(size[alone]) - size[alone] + len(flat)
            flat = np.concatenate([flat, *(np.array(x, np.int32) for x in own)])
        upto = np.cumsum(size)
        ids = flat[np.repeat(start - (upto - size), size) + np.arange(int(size.sum()))]
        ends = np.append(0, upto)[np.cumsum([0, *counts])]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, text: str, document: int = 0) -> list[int]:
        return self.encode_all([text], [document])[0].tolist()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, seed: int = 17, dropout: float = 0.1, with_ids: bool = False) -> DataFrame:
    """(id_col, n_pieces, ids_crc32, n_bytes, lossless) for each row; with_ids adds the ids."""
    path = model_path or default_model()
    schema = docs.select(id_col).schema
    names = ["n_pieces", "ids_crc32", "n_bytes", "lossless"]
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.LongType(), T.BooleanType()), strict=True):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path), seed, dropout)
        decode = encoder.vocabulary.decode
        for part in (part for whole in batches for part in textkit.slices(whole, 512)):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows, kept = [], []
            for text, ids in zip(texts, encoder.encode_all(texts, [d & _ALL for d in part.column(2).to_pylist()]), strict=True):
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(text.encode("utf-8", "surrogatepass")), decode(ids.tolist()) == text))
                if with_ids:
                    kept.append(ids.tolist())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            arrays = [part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=[id_col, *names, *(["ids"] if with_ids else [])])

    return sparkkit.mapped(docs.select(id_col, F.col(text_col).cast("string").alias("_text"), F.xxhash64(id_col).alias("_key")), run, schema)
