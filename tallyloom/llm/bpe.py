"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by the last token of each of its prefixes: a token may end a prefix exactly if it and
the last token of what stands before it stay apart when they alone are encoded. So the distinct words are walked
depth-first in trie order (sorted words; only the current root-to-leaf path is held), each prefix gets its last token
once, for all words that share it, and a word's tokens are read backwards from its end.

Results are those of the ``tokenizers`` library for vocabularies of this family (NFC, lower case, white space dropped,
letters / single numbers / other signs apart, byte-level symbols, word-end suffix, special tokens matched in raw text).

Defined results: null and empty texts give no tokens and decode to the empty string; texts of white space alone too;
other columns pass through; repeated rows are kept; an empty table gives an empty table. A text of any length is
encoded whole. The memo of frequent words is bounded (``MEMO``), which never changes a result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tallyloom.llm.common import gathered, small_batches, trimmed

#: Entries of the memo from white-space-delimited chunks to token ids, in one Python worker.
MEMO = 130_000
#: Bytes of text that share one traversal.
TOGETHER = 10 << 20
OPEN, CLOSED = "open", "closed"


#: Letters below this one are letters in every version of Unicode's tables.
LATIN = "\u0250"
#: White space to ``str.split``, signs to the vocabulary's pattern.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTrie:
    """Token ids of distinct words by depth-first traversal with a last-token state at every prefix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str, code: str = "I") -> None:
        self.code = code
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (r, vocab[a], vocab[b]) for r, (a, b) in reversed([*enumerate(merges)])}
        self.apart: dict[tuple[int, int], bool] = {}
        #: The vocabulary as nested dicts by symbol; OPEN and CLOSED have the token that ends there, without and with the suffix.
        self.tokens: dict = {}
        for name, token in vocab.items():
            closed = bool(suffix) and name.endswith(suffix) and name != suffix
            if not self.reachable(token):
                continue
            node = self.tokens
            for symbol in name[: len(name) - len(suffix)] if closed else name:
                node = node.setdefault(symbol, {})
            node[CLOSED if closed else OPEN] = token
        self.closing = CLOSED if suffix else OPEN

    def reachable(self, token: int) -> bool:
        """Merging its own symbols gives the token back: its two parts meet as neighbours and are made themselves."""
        if token not in self.made:
            return True
        _, left, right = self.made[token]
        return self.stay_apart(left, right, self.made[token][0])

    def stay_apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """No merge crosses the border of the two while their symbols are merged, before the merge of rank ``limit``.

        Merges are undone from the last one back: between two of them the tokens at the border are known, and theirs
        would have come first if its rank is lower; of equal ranks the one further left comes first.
        """
        rank, made = self.rank, self.made
        crossing = rank.get((left, right), limit)
        if crossing < limit:
            return False
        base = (-1, -1, -1)
        while True:
            l, r = made.get(left, base), made.get(right, base)
            if l[0] < 0 and r[0] < 0:
                return True
            if l[0] > r[0]:
                left = l[2]
                if rank.get((left, right), limit) < l[0]:
                    return False
            else:
                right = r[1]
                if rank.get((left, right), limit) <= r[0]:
                    return False

    def last(self, alive: list, key: str, path: list) -> tuple[int, int]:
        """(last token, its start) among the vocabulary's tokens that end here, the longest first."""
        apart = self.apart
        for start, node in alive:
            token = node.get(key)
            if token is None:
                continue
            if not start:
                return token, 0
            pair = path[start][0], token
            fits = apart.get(pair)
            if fits is None:
                if len(apart) > 1_000_000:
                    apart.clear()
                fits = apart[pair] = self.stay_apart(*pair)
            if fits:
                return token, start
        raise ValueError("the vocabulary lacks a byte symbol")

    def encode(self, words: set[str]) -> dict[str, bytes]:
        """words: distinct, in byte symbols. The traversal shares every common prefix between neighbours in order.

        path[k]: last token of the first k symbols, where it starts, and the vocabulary nodes that go on from there.
        """
        out, path, before, tokens, closing, code, apart = {}, [(-1, 0, [])], "", self.tokens, self.closing, self.code, self.apart
        for word in sorted(words):
            same, most = 0, min(len(before), len(word), len(path) - 1)
            while same < most and before[same] == word[same]:
                same += 1
            del path[same + 1 :]
            for end in range(len(path) - 1, len(word)):
                symbol = word[end]
                alive = [(s, n[symbol]) for s, n in path[end][2] if symbol in n]
                if symbol in tokens:
                    alive.append((end, tokens[symbol]))
                if end + 1 < len(word):
                    for start, node in alive:
                        if OPEN in node and (not start or apart.get((path[start][0], node[OPEN]))):
                            path.append((node[OPEN], start, alive))
                            break
                    else:  # a pair that has not been met
                        path.append((*self.last(alive, OPEN, path), alive))
            if len(path) > len(word):  # the word is a prefix of the one before: its last symbol is closed here
                alive = path[len(word)][2]
            for at, node in alive:
                token = node.get(closing)
                if token is not None and (not at or apart.get((path[at][0], token))):
                    break
            else:
                token, at = self.last(alive, closing, path)
            ids = [token]
            while at:
                token, at, _ = path[at]
                ids.append(token)
            ids.reverse()
            out[word] = array(code, ids).tobytes()
            before = word
        return out


#: First letter of the chunk of a special token, and of a chunk whose separators are written as capitals; the chunk that
#: stands for a text's end. No normalised chunk has a capital.
SPECIAL, ESCAPED, END = "S", "X", "E"
_ESCAPE = dict(zip(map(ord, SEPARATORS), "CDFG", strict=True))
_PLAIN = {ord(v): k for k, v in _ESCAPE.items()}


class Encoder:
    """Whole texts to token ids and back, for a vocabulary file of the ``tokenizers`` library.

    vocabulary: the file's contents. Distinct words are encoded by the trie, or, with ``library``, by that library's model.
    """

    def __init__(self, vocabulary: bytes, library: bool = False) -> None:
        import regex

        spec = json.loads(vocabulary)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Array code of token ids: two bytes where they suffice.
        self.code = "H" if max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])], default=0) < 1 << 16 else "I"
        self.contents = vocabulary
        if library:
            self.tokenize = self.library.model.tokenize
            self.encode_words, self.learn = self.by_library, self.learn_each
        else:
            self.encode_words = WordTrie(model["vocab"], merges, model["end_of_word_suffix"] or "", self.code).encode
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.found = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).findall if self.special else None
        self.blank = regex.compile(r"\s+").split
        self.stand_in = dict(enumerate(_byte_symbols()))
        self.memo: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.ends = self.encode_words(set(".,;:!?"))  # the signs that most often follow a word

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.contents.decode())

    def words(self, chunk: str) -> list[str]:
        """Words of a normalised chunk without white space, in byte symbols.

        Signs that Python's tables don't know yet may be letters to the library: it cuts such chunks itself.
        """
        if not chunk.isascii() and any(category(c) == "Cn" for c in chunk):
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]
        found = self.pieces(chunk)
        if chunk.isascii():
            return found if chunk.isprintable() else [p.translate(self.stand_in) for p in found]
        return [p.encode().decode("latin-1").translate(self.stand_in) for p in found]

    def chunks(self, text: str) -> list[str]:
        """White-space-delimited parts of the normalised text, and special tokens after ``SPECIAL``, which no part holds."""
        if self.special and any(s in text for s in self.special):
            out, between = [], self.found(text)
            for i, part in enumerate(self.cut(text)):
                out += self.plain_chunks(part)
                if i < len(between):
                    out.append(SPECIAL + between[i])
            return out
        return self.plain_chunks(text)

    def normalised(self, text: str) -> str:
        if not text.isascii():  # lower-casing is letter by letter: the Greek final sigma doesn't arise
            text = (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return text.lower()

    def plain_chunks(self, text: str) -> list[str]:
        text = self.normalised(text)
        if any(c in text for c in SEPARATORS):
            return [c for c in self.blank(text) if c]
        return text.split()

    def escaped(self, text: str) -> str:
        """Normalised, with chunks that only spaces divide."""
        return " ".join([ESCAPED + c.translate(_ESCAPE) if any(s in c for s in SEPARATORS) else c for c in self.chunks(text)])

    def flat(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; where each text's ids stop), with ``library``.

        Arrow splits the texts and numbers their chunks; Python meets distinct chunks alone.
        """
        odd, close = (*self.special, *SEPARATORS), "" if end is None else " " + END
        plain = [(self.escaped(t) if any(s in t for s in odd) else self.normalised(t)) + close for t in (x or "" for x in texts)]
        split = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct, index, stops = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        self.learn(set(distinct) - {"", END})
        memo, fixed = self.memo, {"": b"", END: b"" if end is None else array(self.code, [end]).tobytes()}
        blobs = [fixed[c] if c in fixed else memo[c] for c in distinct]
        ids = np.frombuffer(b"".join(blobs), np.dtype(f"<u{array(self.code).itemsize}"))
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // ids.itemsize
        starts, counts = np.cumsum(sizes) - sizes, sizes[index]
        upto = np.cumsum(counts)
        at = np.repeat(starts[index] - (upto - counts), counts)
        at += np.arange(len(at))
        return ids[at], np.r_[0, upto][stops[1:]]

    def learn(self, chunks: set[str]) -> None:
        """Put the unknown chunks into the memo: one trie traversal over their distinct new words."""
        new = chunks.difference(self.memo)
        if len(self.memo) + len(new) > 2 * MEMO:  # what is met again stays
            self.memo = {c: self.memo[c] for c in chunks if c in self.memo}
        memo, known, special, words = self.memo, self.known, self.special, {}
        collecting = gc.isenabled()
        gc.disable()  # millions of small lasting objects, none in a cycle
        try:
            one, ends = {}, self.ends
            for c in new:
                if c.isascii():
                    if c.isalpha():
                        if c in known:
                            memo[c] = known[c]
                        else:
                            one[c] = c, b""
                        continue
                    if c[-1] in ends and c[:-1].isalpha():
                        one[c] = c[:-1], ends[c[-1]]
                        continue
                if c[0] == SPECIAL:
                    memo[c] = array(self.code, [special[c[1:]]]).tobytes()
                else:
                    words[c] = self.words(c)
            distinct = {w for w, _ in one.values()}
            distinct.update(w for ws in words.values() for w in ws)
            unknown = distinct.difference(known)
            if len(known) + len(unknown) > 2 * MEMO:
                known = self.known = {w: known[w] for w in distinct if w in known}
            known.update(self.encode_words(unknown))
            for c, (w, end) in one.items():
                memo[c] = known[w] + end
            for c, ws in words.items():
                memo[c] = b"".join([known[w] for w in ws])
        finally:
            if collecting:
                gc.enable()

    def by_library(self, words: set[str]) -> dict[str, bytes]:
        return {w: array(self.code, [t.id for t in self.tokenize(w)]).tobytes() for w in words}

    def learn_each(self, chunks: set[str]) -> None:
        """``learn`` for the library's model, one word after another: a word that was met as a chunk of its own is known."""
        new = chunks.difference(self.memo)
        if len(self.memo) + len(new) > 2 * MEMO:
            self.memo = {c: self.memo[c] for c in chunks if c in self.memo}
        memo, ends, tokenize, code, stand_in = self.memo, self.ends, self.tokenize, self.code, self.stand_in
        collecting = gc.isenabled()
        gc.disable()
        try:
            for c in new:
                if c[0] == SPECIAL:
                    memo[c] = array(code, [self.special[c[1:]]]).tobytes()
                    continue
                if c[0] == ESCAPED:
                    memo[c] = array(code, [t.id for w in self.words(c[1:].translate(_PLAIN)) for t in tokenize(w)]).tobytes()
                    continue
                close = ends.get(c[-1])
                word = c if close is None else c[:-1]
                if word.isalpha() and (word.isascii() or max(word) < LATIN):  # one word, and perhaps one sign
                    found = memo.get(word)
                    if found is None:
                        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(stand_in)
                        found = array(code, [t.id for t in tokenize(symbols)]).tobytes()
                    memo[c] = found if close is None else found + close
                else:
                    memo[c] = array(code, [t.id for w in self.words(c) for t in tokenize(w)]).tobytes()
        finally:
            if collecting:
                gc.enable()

    def batches(self, texts: list[str | None], most: int = 2 * MEMO) -> Iterator[tuple[list[str], dict[str, bytes]]]:
        """Chunks of every text with a memo of their ids (unsigned 32-bit) that is good until the next item."""
        held: list[list[str]] = []
        fresh: set[str] = set()

        def known() -> Iterator[tuple[list[str], dict[str, bytes]]]:
            self.learn(fresh)
            for x in held:
                yield x, self.memo

        for text in texts:
            chunks = self.chunks(text or "")
            fresh.update(chunks)
            held.append(chunks)
            if len(fresh) >= most:
                yield from known()
                held, fresh = [], set()
        yield from known()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [array(self.code, b"".join([memo[c] for c in chunks])).tolist() for chunks, memo in self.batches(texts)]

    def decode(self, ids) -> str:
        """Names of all tokens, special ones too, joined by a space: this vocabulary names no decoder."""
        names = self.names
        return " ".join([names[i] for i in ids])


_encoders: dict[tuple[bytes, bool], Encoder] = {}


def vocabulary(path: str) -> bytes:
    """The file's contents, read by the driver; tasks get them with the function, so executors need no such file."""
    with open(path, "rb") as file:
        return file.read()


def encoder(contents: bytes, library: bool = False) -> Encoder:
    """One for each vocabulary in a Python worker."""
    at = hashlib.sha256(contents).digest(), library
    if at not in _encoders:
        _encoders.clear()
        _encoders[at] = Encoder(contents, library)
    return _encoders[at]


def id_type(path: str) -> np.dtype:
    """How ``encoded_bytes`` stores ids: unsigned little-endian, as narrow as the vocabulary allows."""
    spec = json.loads(vocabulary(path))
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])], default=0)
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and the token ids of ``text`` as array<int> (a column of that name is replaced)."""
    kept, contents = [c for c in df.columns if c != ids], vocabulary(path)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = encoder(contents).encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n in kept), pa.array(out, pa.list_(pa.int32()))], names=[*(n for n in batch.schema.names if n in kept), ids])

    return df.select(*kept).mapInArrow(run, StructType([*df.select(*kept).schema.fields, StructField(ids, ArrayType(IntegerType()))]))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of the token ids; null ids give the empty string."""
    kept, contents = [c for c in df.columns if c != text], vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encoder(contents).decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, n in enumerate(batch.schema.names) if n in kept), pa.array(out, pa.string())], names=[*(n for n in batch.schema.names if n in kept), text])

    return df.select(*kept).mapInArrow(run, StructType([*df.select(*kept).schema.fields, StructField(text, StringType())]))


def encoded_bytes(df: DataFrame, path: str, end: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary): ids as ``id_type(path)`` numbers, with ``end`` after each text.

    Distinct words are encoded by the ``tokenizers`` library's model, which takes a sixth of the trie's time.
    """
    contents = vocabulary(path)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text, TOGETHER):
            ids, stops = encoder(contents, library=True).flat(batch.column(1).to_pylist(), end)
            borders = np.r_[0, stops]
            blobs = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(borders * ids.itemsize), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(borders)), blobs.cast(pa.binary())], names=[key, "n_tokens", "ids"])

    return df.select(key, text).mapInArrow(trimmed(run), StructType([df.schema[key], StructField("n_tokens", LongType()), StructField("ids", BinaryType())]))


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; (key, n_tokens long, ids_sha256, decoded_sha256 string), one row for each row."""
    contents = vocabulary(path)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, text, TOGETHER):
            enc, counts, codes, texts, shown = encoder(contents), [], [], [], {}
            for chunks, memo in enc.batches(batch.column(1).to_pylist()):
                for c in chunks:
                    if c not in shown:
                        ids = array(enc.code, memo[c])
                        shown[c] = (" ".join(map(str, ids)), enc.decode(ids), len(ids))
                found = [x for c in chunks if (x := shown[c])[2]]
                counts.append(sum([x[2] for x in found]))
                codes.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
                if len(shown) > 2 * MEMO:
                    shown.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(codes, pa.string()), pa.array(texts, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(trimmed(run), StructType([df.schema[key], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))
