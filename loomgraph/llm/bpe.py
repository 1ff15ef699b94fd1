"""BPE encoding and decoding by a pair occurrence index."""

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean

#: Words kept with their encoding, per Python worker; more are encoded again when they come back.
KEPT_WORDS = 100_000
#: Bytes of text whose words are encoded together.
_CHUNK = 1 << 19


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if it prints in Latin-1, else the next from U+0100 on."""
    spare = iter(range(256, 512))
    return [chr(b) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256) else chr(next(spare)) for b in range(256)]


#: First and last of the code points that Unicode 17 and 18 made letters or numbers; the tokenizers library's classes are those of Unicode 16.
LATER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""
#: Capital letters of Unicode 16 and 17, which the library lower-cases and Python does not, first and last, and the first's small letter.
CAPITALS = "1c89-1c89-1c8a a7cb-a7cb-264 a7cc-a7cc-a7cd a7ce-a7ce-a7cf a7d2-a7d2-a7d3 a7d4-a7d4-a7d5 a7da-a7da-a7db a7dc-a7dc-19b 10d50-10d65-10d70 16ea0-16eb8-16ebb"
_LATER = "[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in LATER.split())) + "]"
_SMALL = {c: small + c - first for first, last, small in ((int(y, 16) for y in x.split("-")) for x in CAPITALS.split()) for c in range(first, last + 1)}
_RARE = np.zeros(0x110000, bool)
for _first, _last in [*((int(a, 16), int(b, 16)) for a, b in (x.split("-") for x in LATER.split())), *((c, c) for c in _SMALL)]:
    _RARE[_first : _last + 1] = True


class WordBpe:
    """A BPE with word ends from a tokenizer file: NFC, lower case, a split pattern whose matches are the words, bytes as letters, merges.

    Letters and numbers are those of Unicode 16, small letters those of Unicode 17, as the tokenizers library has them. The file's added
    tokens stand for themselves wherever their strings occur in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        pattern = pattern.replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        # of ASCII texts in lower case the same, by the quicker module
        self.ascii_words = re.compile(pattern.replace(r"\p{White_Space}", r"\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        # texts with later letters, which are next to none, are cut by a pattern that leaves them out of its classes
        exact = pattern.replace(r"[^\p{White_Space}\p{L}\p{N}]", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{_LATER})")
        for kind in (r"[\p{L}]", r"[\p{N}]"):
            exact = exact.replace(f"|{kind}", f"|(?:(?!{_LATER}){kind})")
        self.exact_words = regex.compile(exact).findall
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.made = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank_of = {a << 20 | b: rank for rank, (a, b, _) in enumerate(self.made)}
        letters = _byte_letters()
        self.first = np.array([self.vocab[x] for x in letters])
        self.shift = self.vocab[letters[0] + self.end] - self.vocab[letters[0]]
        assert all(self.vocab[x + self.end] - self.vocab[x] == self.shift for x in letters)
        # ranks of pairs of letters, the second one also at a word's end
        seconds = [*self.first.tolist(), *(self.first + self.shift).tolist()]
        self.first_ranks = np.array([[self.rank_of.get(a << 20 | b, -1) for b in seconds] for a in self.first.tolist()])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda text: [text]
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.named = pa.array([self.names.get(i, "").encode() for i in range(max(self.names) + 1)], pa.binary())
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.met, self.n_met = np.zeros(1 << 22, bool), 0

    def pieces(self, text: str) -> list[str]:
        """The text's words and added tokens in order."""
        if not any(x in text for x in self.added):
            return self._words(text)
        out = []
        for part in self.split(text):
            out += [part] if part in self.added else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # lower case of each character alone: a sigma stays one at a word's end
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _RARE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
                return self.exact_words(text.translate(_SMALL).lower())
            return self.words(text.lower())
        return self.ascii_words(text.lower())

    def merge(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Of every word the token ids as bytes, and the decoded tokens.

        All words' symbols lie in one row with gaps between words. An index maps each pair that
        has a rank to all its positions. The least active rank is merged wherever its pair still
        stands, from the left; the pairs that this makes join the index. A merge's token occurs
        in later ranks only, so each rank comes up once.
        """
        if not words:
            return []
        coded = [x.encode("utf-8", "surrogatepass") for x in words]
        letter = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64)
        last = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) - 1
        n = len(letter)
        ends = np.zeros(n, np.int64)
        ends[last] = 1
        symbol = (self.first[letter] + self.shift * ends).tolist()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last], before[0], before[last[:-1] + 1] = -1, -1, -1
        after, before = after.tolist(), before.tolist()
        rank_of, made = self.rank_of.get, self.made
        ranks = np.where(ends[:-1] == 1, -1, self.first_ranks[letter[:-1], letter[1:] + 256 * ends[1:]])
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        ranks = ranks[at]
        begins = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]][: len(ranks)])
        listed, bounds = at.tolist(), [*begins.tolist(), len(at)]
        places: dict[int, list[int]] = {rank: listed[a:b] for rank, a, b in zip(ranks[begins].tolist(), bounds, bounds[1:], strict=False)}
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, token = made[rank]
            here = places.pop(rank)
            here.sort()
            for i in here:
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = token, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    found = rank_of(token << 20 | symbol[k])
                    if found is not None:
                        if found in places:
                            places[found].append(i)
                        else:
                            places[found] = [i]
                            heapq.heappush(active, found)
                h = before[i]
                if h >= 0:
                    found = rank_of(symbol[h] << 20 | token)
                    if found is not None:
                        if found in places:
                            places[found].append(h)
                        else:
                            places[found] = [h]
                            heapq.heappush(active, found)
        left = np.array(symbol, np.int64)
        ids = left[left >= 0].astype("<u4")
        bounds = np.r_[0, np.cumsum(left >= 0)[last]]
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.named.take(pa.array(ids))), b" ").to_pylist()
        raw, bounds = ids.tobytes(), (4 * bounds).tolist()
        return list(zip([raw[a:b] for a, b in zip(bounds, bounds[1:])], decoded, strict=True))

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """The encodings of ``pieces`` that ``known`` lacks: ids as bytes, and the decoded tokens.

        Words that come back in a later call are kept from then on; those not met while KEPT_WORDS
        others were kept are let go. Most words of a corpus come once and take no room.
        """
        if len(self.known) > KEPT_WORDS:
            self.old, self.known = self.known, {}
        fresh = pieces.difference(self.known)
        for x in fresh.intersection(self.old):
            self.known[x] = self.old[x]
        fresh.difference_update(self.known)
        plain = [x for x in fresh if x not in self.added]
        found = dict(zip(plain, self.merge(plain), strict=True))
        found |= {word: (struct.pack("<I", self.added[word]), word.encode()) for word in fresh if word in self.added}
        marks = np.fromiter(map(hash, found), np.int64, len(found)) & (len(self.met) - 1)
        listed = list(found)
        for i in np.flatnonzero(self.met[marks]).tolist():
            self.known[listed[i]] = found[listed[i]]
        self.met[marks] = True
        self.n_met += len(found)
        if self.n_met > len(self.met) // 4:
            self.met[:], self.n_met = False, 0
        return found

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with spaces between, special ones too: the file names no decoder. Unknown ids are passed over."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def encode(self, text: str) -> list[int]:
        return [i for i, in struct.iter_unpack("<I", self.encoded([text])[0][0])]

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text in UTF-8) of every text."""
        cut = [self.pieces(x) for x in texts]
        pieces = set().union(*cut)
        found = self.learn(pieces)
        known = {x: self.known[x] for x in pieces.difference(found)}
        known.update(found)
        out = []
        for pieces in cut:
            ids, names = zip(*map(known.__getitem__, pieces), strict=True) if pieces else ((), ())
            out.append((b"".join(ids), b" ".join(names)))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _encode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1)
            i = 0
            while i < batch.num_rows:
                group, size = [], 0
                j = i
                while j < batch.num_rows and (not group or size < _CHUNK):
                    group.append(texts[j].as_py() or "")
                    size += len(group[-1])
                    j += 1
                coded = bpe.encoded(group)
                own = batch.slice(i, j - i)
                counts = pa.array([len(a) // 4 for a, _ in coded], pa.int64())
                if digests:
                    cols = [pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in zip(*coded, strict=True)]
                else:
                    cols = [pa.array([memoryview(a).cast("I").tolist() for a, _ in coded], pa.list_(pa.int64())), pa.array([b.decode("utf-8", "replace") for _, b in coded])]
                yield pa.RecordBatch.from_arrays([own.column(0), counts, *cols], ["id", "n", "a", "b"])
                i = j

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row's whole text; with ``digests`` their SHA-256 as ids_sha256, decoded_sha256.

    ``vocabulary`` is the path of a tokenizer file that every executor has. Words are encoded
    once per worker while they are among the KEPT_WORDS. Null and empty texts have no tokens;
    a text of any length is taken whole. Rows are independent, so ties and repeated rows need
    no rule; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(_encode(vocabulary, digests)), f"id {kind}, n long, a string, b string" if digests else f"id {kind}, n long, a array<long>, b string")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("a").alias(names[0]), F.col("b").alias(names[1]))


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode([i for i in x.as_py() or [] if i is not None]) for x in batch.column(1)], pa.string())], ["id", "text"])

    return run


def bpe_decode(rows: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the token strings of every row's ids; null ids are no ids, unknown ones are passed over."""
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(lean(_decode(vocabulary)), f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
