"""Language-model scores by logistic mixing of bit predictors in hashed contexts."""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean
from .packed import planes, unplanes
from .scratch import Scratch, parts_for
from .words import mix, text_batches, word_spans

#: Words of a context that predicts the next word, and rounds in which contexts, by their hash, are dealt to ranges, so that half of them is on disk at a time.
ORDER, ROUNDS = 3, 2
#: Contexts of a letter's bits: the 1 to LETTERS letters before it in its word, hashed to SLOTS places each.
LETTERS, SLOTS = 4, 1 << 18
#: Rounds in which the spelling's weights are fitted on all training words, steps of a task in a round, and letters of a step at least and at most.
FITS, STEPS, LEAST, STEP = 4, 40, 256, 1 << 12
#: Letters in contexts of a task whose inputs are kept for all steps of a round; with more, each step looks its own up.
KEPT = 1 << 18
#: Bytes of text that a task gathers before it deals its words and contexts out.
CHUNK = 8 << 20
_MESSAGE = "to int, chunk long, kind int, part int, a binary, b binary, c binary, d binary, n long, v long, once long, twice long"
_NAMES = [x.split()[0] for x in _MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 4]
_WORDS, _SEEN, _ASKED, _TEXTS, _COUNTS, _NEXT, _TABLE, _LETTERS = range(8)
#: The end of a text counts as a word, without letters.
_END = np.uint64(0x5A17E0D1CE5EED5)
_SUCCESSOR = np.uint64((1 << 40) - 1)
_SPACE = 32
_OUTCOMES = 9
_CODES = 4 * 5 * _OUTCOMES
#: Shares that a text's own words so far may have in the next word's probability, and places in the text from which on one share holds.
SHARES = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
_GATES = (0, 1, 8, 32, 128, 512, 2048)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    wide = [(*r, *[None] * (len(_NAMES) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*wide, strict=True), _TYPES, strict=True)], _NAMES)


def _slim(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, byte by byte: leading zeros shrink when compressed."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _full(raw, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _squeezed(raw: bytes) -> bytes:
    """Compressed, after its length: letters and places of words shrink by half."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _loosened(raw) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _home(chunk: int, parts: int) -> int:
    return int(mix(np.array([chunk], np.uint64))[0] % np.uint64(parts))


def contexts(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes of the ORDER words before) of all words that so many of the same text stand before."""
    value = np.zeros(len(words), np.uint64)
    for back in range(ORDER, 0, -1):
        moved = np.zeros_like(words)
        moved[back:] = words[:-back]
        value = mix(value + moved)
    inside = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
    at = np.flatnonzero(inside >= ORDER)
    return at, value[at]


def _chunks(parts: int):
    """(id, held out, text) to a row a chunk of texts: its distinct words' hashes, their order by how frequent they are, the texts as places in that order, and ids, sizes and letters."""

    def chunk_of(number: int, given: list[tuple]) -> pa.RecordBatch:
        ids, held, sizes, lengths, words, spans = ([x for g in given for x in g[i]] if i == 0 else np.concatenate([g[i] for g in given]) for i in range(6))
        low = np.concatenate([g[6] for g in given])
        known, one, place = _distinct(words)
        # frequent words first, of equally frequent ones that with the least hash
        order = np.sort((len(place) - np.bincount(place, minlength=len(known))) << 32 | np.arange(len(known))) & 0xFFFFFFFF
        rank = np.zeros(len(known), np.int64)
        rank[order] = np.arange(len(known))
        letters = _picked(low, spans[one, 0], spans[one, 1])
        rest = pickle.dumps((ids, held, lengths, sizes, spans[one, 1].astype(np.int32), letters))
        return _batch([(_home(number, parts), number, _TEXTS, 0, planes(known), _squeezed(_slim(order, 4)), _squeezed(_slim(rank[place], 4)), _squeezed(rest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, given, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for i, raw, ends in text_batches(batch.column(2)):
                hashes, starts, lengths, first = word_spans(raw, ends)
                low = raw.copy()
                low[(low >= 65) & (low <= 90)] += 32
                # the end has no letters
                n, at = len(ends) - 1, first[1:]
                given.append((ids[i : i + n], held[i : i + n], np.diff(ends), np.diff(first) + 1, np.insert(hashes, at, _END), np.insert(np.column_stack([starts + size, lengths]), at, 0, axis=0), low))
                size += len(raw)
                if size >= CHUNK:
                    yield chunk_of(number, given)
                    number, given, size = number + 1, [], 0
        if given:
            yield chunk_of(number, given)

    return run


def _ordered(values: np.ndarray) -> np.ndarray:
    """The places of hashes in rising order, of equal ones as they come: by a plain sort of their high 40 bits with their places, 24 bits; the few that differ only in the low bits are put right."""
    n, low = len(values), np.uint64((1 << 24) - 1)
    if n >= 1 << 24:
        return np.argsort(values, kind="stable")
    order = (np.sort(values & ~low | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    value = values[order]
    wrong = np.flatnonzero(value[1:] < value[:-1])
    if len(wrong) > 50:
        return np.argsort(values, kind="stable")
    if len(wrong):
        high = value >> np.uint64(24)
        at = np.flatnonzero(np.isin(high, high[wrong]))
        order[at] = order[at][np.argsort(value[at], kind="stable")]
    return order


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different values rising, a place of each, each place's value among them)."""
    order = _ordered(values)
    new = np.r_[True, values[order][1:] != values[order][:-1]] if len(values) else np.zeros(0, bool)
    back = np.zeros(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return values[order[new]], order[new], back


def _distinct_letters(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different letters in contexts rising, each place's among them): 40 bits each, so a plain sort of them with their places, 24 bits, puts them in order."""
    if len(pairs) >= 1 << 24:
        value, _, back = _distinct(pairs)
        return value, back
    key = np.sort(pairs << np.uint64(24) | np.arange(len(pairs), dtype=np.uint64))
    value, order = key >> np.uint64(24), (key & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.r_[True, value[1:] != value[:-1]][: len(value)]
    back = np.zeros(len(pairs), np.int64)
    back[order] = np.cumsum(new) - 1
    return value[new], back


def _picked(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> bytes:
    """The named stretches of a text, one after the other."""
    ends = np.cumsum(sizes)
    return text[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


def _pairs(context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether a pair of context and next word is another than the one before, contexts in that order): sorted by both; only contexts that recur are sorted by the word too."""
    order = _ordered(context)
    value = context[order]
    same = value[1:] == value[:-1]
    if same.any():
        again = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        order[again] = order[again][np.lexsort((after[order[again]], value[again]))]
    word = after[order]
    return order, np.r_[True, ~same | (word[1:] != word[:-1])] if len(value) else np.zeros(0, bool), value


def _opened(a, b, c, d) -> tuple:
    """(hashes of the chunk's words, the places of its texts' words among them, what belongs to its texts) of a chunk's row."""
    order, rank = (_full(_loosened(x), 4).astype(np.int64) for x in (b, c))
    return unplanes(a), order[rank], pickle.loads(_loosened(d))


def _rows(batches: Iterator[pa.RecordBatch], part: bool = False) -> Iterator[tuple]:
    """(chunk, kind, with ``part`` that, a, b, c, d) of messages."""
    for batch in batches:
        for r in range(batch.num_rows):
            yield (batch.column(1)[r].as_py(), batch.column(2)[r].as_py(), *([batch.column(3)[r].as_py()] if part else []), *[batch.column(i)[r].as_py() for i in range(4, 8)])


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes by the ranges that have any."""
    at = np.r_[np.searchsorted(values, bounds), len(values)].tolist()
    return [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]


def _deal_words(parts: int):
    """Chunks to messages of their distinct words: hashes, how many are of training texts, and letters."""
    bounds = np.array([(p << 64) // parts for p in range(parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, *row in _rows(batches):
            known, place, (_, held, lengths, _, sizes, letters) = _opened(*row)
            counts = np.bincount(place[np.repeat(~held, lengths)], minlength=len(known))
            cuts = np.r_[0, np.cumsum(sizes, dtype=np.int64)].tolist()
            out = [(p, chunk, _WORDS, 0, planes(known[a:b]), _slim(counts[a:b], 6), _slim(sizes[a:b], 4), _squeezed(letters[cuts[a] : cuts[b]])) for p, a, b in _cut(known, bounds)]
            yield _batch(out)

    return run


def _asked(value: np.ndarray, where: np.ndarray, words: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
    """(places, their pairs' numbers, contexts, next words and how often each pair comes) of the contexts ``chosen``; pairs rise."""
    where, context = where[chosen], value[chosen]
    after = words[where] & _SUCCESSOR
    order, new, context = _pairs(context, after)
    pair = np.zeros(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return where, pair, context[new], after[order[new]], np.bincount(pair, minlength=int(new.sum()))


def _rounds(words: np.ndarray, held: np.ndarray, lengths: np.ndarray, turns: list[int]) -> Iterator[tuple[tuple, tuple]]:
    """For each of the rounds the pairs of training texts and those of held-out ones."""
    where, value = contexts(words, np.r_[0, np.cumsum(lengths)])
    out = np.repeat(held, lengths)[where]
    of = value % np.uint64(ROUNDS)
    for turn in turns:
        now = of == np.uint64(turn)
        yield _asked(value, where, words, now & ~out), _asked(value, where, words, now & out)


def _deal_contexts(parts: int, turn: int):
    """Chunks to messages of the contexts of a round with the words after them, of training texts how often, and of held-out ones."""
    bounds = np.array([(p << 64) // parts for p in range(parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, *row in _rows(batches):
            known, place, (_, held, lengths, *_) = _opened(*row)
            (both,) = _rounds(known[place], held, lengths, [turn])
            out = [(p, chunk, kind, 0, planes(seen[a:b]), _slim(after[a:b], 5), _slim(times[a:b], 4)) for kind, (_, _, seen, after, times) in zip((_SEEN, _ASKED), both, strict=True) for p, a, b in _cut(seen, bounds)]
            if out:
                yield _batch(out)

    return run


# Spelling: the bits of a word's letters and of the space after it.


def _letters(sizes: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, letters, word) of all letters of the words and of the space after each; a context is the LETTERS bytes before, spaces where the word begins."""
    n = len(sizes)
    ends = np.cumsum(sizes + 1)
    flat = np.full(int(ends[-1]) if n else 0, _SPACE, np.uint64)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = np.frombuffer(text, np.uint8)
    place = np.arange(len(flat)) - np.repeat(ends - sizes - 1, sizes + 1)
    value = np.zeros(len(flat), np.uint64)
    for back in range(LETTERS, 0, -1):
        before = np.full(len(flat), _SPACE, np.uint64)
        before[back:] = flat[:-back]
        before[place < back] = _SPACE
        value = value << np.uint64(8) | before
    return value, flat, np.repeat(np.arange(n), sizes + 1)


def _slots(context: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """The place of a bit in the table of each order; ``node`` is the letter's bits so far, after a one."""
    out = []
    for order in range(1, LETTERS + 1):
        key = (context & np.uint64((1 << 8 * order) - 1)) << np.uint64(8) | node
        out.append(((mix(key + np.uint64(order << 56)) if order > 1 else key << np.uint64(46)) >> np.uint64(46)).astype(np.int64))
    return out


def bit_counts(sizes: np.ndarray, text: bytes) -> np.ndarray:
    """(orders, slots, 2): how often each bit was 0 and 1 in each context, over the words given."""
    return _bit_counts(*letter_pairs(sizes, text))


def letter_pairs(sizes: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different letters in their contexts, and how often each comes."""
    value, letter, _ = _letters(sizes, text)
    return np.unique(value << np.uint64(8) | letter, return_counts=True)


def _bit_counts(pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
    counts = np.zeros((LETTERS, SLOTS * 2), np.int64)
    context, letter = pairs >> np.uint64(8), pairs & np.uint64(255)
    for i in range(8):
        node = np.uint64(1 << i) | letter >> np.uint64(8 - i)
        bit = (letter >> np.uint64(7 - i) & np.uint64(1)).astype(np.int64)
        for order, slot in enumerate(_slots(context, node)):
            counts[order] += np.bincount(slot * 2 + bit, times, SLOTS * 2).astype(np.int64)
    return counts.reshape(LETTERS, SLOTS, 2)


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


class Mixer:
    """Logistic mixing: one set of weights a gate, and a table that refines what they give, both learnt online.

    The probability of a one is ``squash(weights[gate] . inputs)``; the inputs are stretched probabilities. The last input is a
    constant. The refining table has a curve a context over the mix's stretched probability, read between its two nearest
    points; what is predicted is the mean of the mix and the curve. Each step moves the weights of the gates met against
    the coding cost's gradient, and the curve's points to the bits seen.
    """

    def __init__(self, gates: int, inputs: int, refined: int, rate: float = 0.02):
        self.weights, self.rate = np.full((gates, inputs), 1.2 / inputs), rate
        self.weights[:, -1] = 0
        self.points = np.linspace(-8, 8, 25)
        self.curves, self.hits = np.tile(squash(self.points), (refined, 1)), np.full((refined, len(self.points)), 6.0)

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (np.clip(x, -7.999, 7.999) + 8) * 1.5
        low = at.astype(np.int64)
        return low, at - low

    def predict(self, inputs: np.ndarray, gate: np.ndarray, context: np.ndarray) -> np.ndarray:
        x = np.einsum("nk,nk->n", self.weights[gate], inputs)
        low, part = self._near(x)
        curve = self.curves[context, low] * (1 - part) + self.curves[context, low + 1] * part
        return np.clip((squash(x) + curve) / 2, 1 / 4096, 1 - 1 / 4096)

    def learn(self, inputs: np.ndarray, gate: np.ndarray, context: np.ndarray, bit: np.ndarray, times: np.ndarray, among: tuple[int, int] | None = None) -> None:
        """One step; ``among``: the range that the contexts are in, if not that of all curves."""
        x = np.einsum("nk,nk->n", self.weights[gate], inputs)
        pull = (bit - squash(x)) * times
        met = np.bincount(gate, times, len(self.weights))
        wide = self.weights.shape[1]
        moved = np.bincount((gate[:, None] * wide + np.arange(wide)).ravel(), (pull[:, None] * inputs).ravel(), self.weights.size).reshape(self.weights.shape)
        self.weights += self.rate * moved / np.sqrt(np.maximum(met, 1))[:, None]
        low, part = self._near(x)
        begin, end = among or (0, len(self.hits))
        curves, hits = self.curves[begin:end], self.hits[begin:end]
        at = (context - begin) * len(self.points) + low
        at, weight = np.concatenate([at, at + 1]), np.concatenate([(1 - part) * times, part * times])
        n, ones = (np.bincount(at, x, hits.size).reshape(hits.shape) for x in (weight, weight * np.concatenate([bit, bit])))
        curves[:] = (curves * hits + ones) / (hits + n)
        hits += n


@dataclass
class Speller:
    """Counts of bits in their contexts, (orders, slots, 2), and the mixer of what they predict."""

    counts: np.ndarray
    mixer: Mixer

    def _inputs(self, context: np.ndarray, node: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gates); ``own``, a bit each, is left out of the counts it is in."""
        seen = np.stack([self.counts[order][slot] for order, slot in enumerate(_slots(context, node))], axis=1).astype(np.float64)
        if own is not None:
            seen[np.arange(len(own)), :, own] = np.maximum(seen[np.arange(len(own)), :, own] - 1, 0)
        total = seen.sum(axis=2)
        level = (total > 0).astype(np.int64) + (total > 8)
        gate = (level[:, 3] * 3 + level[:, 2]) * 3 + level[:, 1]
        return np.concatenate([stretch((seen[:, :, 1] + 0.3) / (total + 0.6)), np.full((len(node), 1), 0.3)], axis=1), gate

    def fit(self, sizes: np.ndarray, text: bytes, step: int = 4096) -> None:
        """Two passes over the bits of words that are in the counts, each predicted by the others'."""
        context, letter, _ = _letters(sizes, text)
        for _ in range(2):
            for i in range(0, len(letter), step):
                for b in range(8):
                    own = (letter[i : i + step] >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
                    node = np.uint64(1 << b) | letter[i : i + step] >> np.uint64(8 - b)
                    inputs, gate = self._inputs(context[i : i + step], node, own)
                    self.mixer.learn(inputs, gate, node.astype(np.int64), own, np.ones(len(own)))

    def _bit(self, pairs: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """(inputs, gates, nodes, bits) of the b-th bit of letters in contexts, each left out of its counts."""
        context, letter = pairs >> np.uint64(8), pairs & np.uint64(255)
        own = (letter >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
        node = np.uint64(1 << b) | letter >> np.uint64(8 - b)
        return *self._inputs(context, node, own), node.astype(np.int64), own

    def fit_pairs(self, pairs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One pass over letters in contexts, that come so often, from the mixer's present state: the weights at each gate times what it met, that, and what the curves' points met and saw, to be summed over tasks."""
        mixer = self.mixer
        # a pair is met in many steps of a round, and its inputs are the same in all
        kept = [self._bit(pairs, b) for b in range(8)] if len(pairs) <= KEPT else None
        met = np.zeros(len(mixer.weights))
        hits, ones = mixer.hits.copy(), mixer.curves * mixer.hits
        # a pair's occurrences are spread over the steps, so that each is a fair share of all
        steps = max(1, min(STEPS, int(times.sum()) // LEAST), int(times.sum()) // STEP)
        often = np.minimum(times.astype(np.int64), steps)
        of = np.repeat(np.arange(len(pairs)), often)
        step = ((mix(pairs) % np.uint64(steps)).astype(np.int64)[of] + np.arange(len(of)) - np.repeat(np.cumsum(often) - often, often)) % steps
        order = np.argsort(step, kind="stable")
        cut = np.searchsorted(step[order], np.arange(steps + 1))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            at = of[order[i:j]]
            weight = times[at] / often[at]
            for b in range(8):
                inputs, gate, node, own = [x[at] for x in kept[b]] if kept else self._bit(pairs[at], b)
                mixer.learn(inputs, gate, node, own, weight, (1 << b, 2 << b))
                met += np.bincount(gate, weight, len(met))
        return np.r_[(mixer.weights * met[:, None]).ravel(), met, (mixer.hits - hits).ravel(), (mixer.curves * mixer.hits - ones).ravel()]

    def take(self, sums: np.ndarray) -> None:
        """The mixer after a round: the tasks' weights in proportion to what they met, and the curves of all."""
        mixer = self.mixer
        parts = np.split(sums, np.cumsum([mixer.weights.size, len(mixer.weights), mixer.hits.size]))
        weights, met, hits, ones = parts[0].reshape(mixer.weights.shape), parts[1], *(x.reshape(mixer.hits.shape) for x in parts[2:])
        mixer.weights = np.where(met[:, None] > 0, weights / np.maximum(met, 1e-9)[:, None], mixer.weights)
        mixer.curves = (mixer.curves * mixer.hits + ones) / (mixer.hits + hits)
        mixer.hits = mixer.hits + hits

    def bits(self, sizes: np.ndarray, text: bytes) -> np.ndarray:
        """The bits that each word costs, the space after it included: letters that stand in one context, and bits after which their first bits agree, are looked up once."""
        value, letter, word = _letters(sizes, text)
        pairs, back = _distinct_letters(value << np.uint64(8) | letter)
        cost = np.zeros(len(pairs))
        for i in range(0, len(pairs), 1 << 16):
            some = pairs[i : i + (1 << 16)]
            for b in range(8):
                # pairs rise, so those of one context and one beginning of the letter are neighbours
                shared = some >> np.uint64(8 - b)
                new = np.r_[True, shared[1:] != shared[:-1]]
                node = (np.uint64(256) | some[new] & np.uint64(255)) >> np.uint64(8 - b)
                p = self.mixer.predict(*self._inputs(some[new] >> np.uint64(8), node), node.astype(np.int64))[np.cumsum(new) - 1]
                cost[i : i + (1 << 16)] -= np.log2(np.where(some >> np.uint64(7 - b) & np.uint64(1), p, 1 - p))
        return np.bincount(word, cost[back], len(sizes))


def _count_words(parts: int):
    """Messages of words by range of hashes to the words' counts in all training texts, by chunk; and counts of bits in letters' contexts, over every training word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = [(chunk, unplanes(a), _full(b, 6).astype(np.int64), _full(c, 4).astype(np.int64), _loosened(d)) for chunk, _, a, b, c, d in _rows(batches)]
        if words:
            yield from _counted(TaskContext.get().partitionId(), parts, words)

    return run


def _follow_contexts(parts: int, turn: int):
    """Messages of contexts by range of hashes to what is known of each pair of a context and a next word, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, asked = [], []
        for chunk, kind, a, b, c, _ in _rows(batches):
            (seen if kind == _SEEN else asked).append((chunk, unplanes(a), _full(b, 5), _full(c, 4).astype(np.int64)))
        if seen or asked:
            yield from _followed(TaskContext.get().partitionId() + turn * parts, parts, seen, asked)

    return run


def _counted(p: int, parts: int, words: list) -> Iterator[pa.RecordBatch]:
    known, first, place = _distinct(np.concatenate([w[1] for w in words]))
    counts = np.bincount(place, np.concatenate([w[2] for w in words]), len(known)).astype(np.int64)
    at = 0
    for chunk, own, *_ in words:
        yield _batch([(_home(chunk, parts), chunk, _COUNTS, p, _slim(counts[place[at : at + len(own)]], 6))])
        at += len(own)
    train = counts > 0
    # the letters of each word as one of its chunks gave them
    sizes = np.concatenate([w[3] for w in words])
    text, starts = np.frombuffer(b"".join(w[4] for w in words), np.uint8), np.cumsum(sizes) - sizes
    one, own = first[train], sizes[first[train]]
    pairs, times = letter_pairs(own, _picked(text, starts[one], own))
    table = _bit_counts(pairs, times)
    rows = [(0, 0, _TABLE, order, _slim(table[order].ravel(), 4)) for order in range(LETTERS)]
    home = (mix(pairs) % np.uint64(parts)).astype(np.int64)
    rows += [(to, p, _LETTERS, 0, planes(pairs[home == to]), _slim(times[home == to], 6)) for to in np.unique(home).tolist()]
    rows.append((0, 0, _TABLE, LETTERS, None, None, None, None, int(counts.sum()), int(train.sum()), int((counts == 1).sum()), int((counts == 2).sum())))
    yield _batch(rows)


def _followed(part: int, parts: int, seen: list, asked: list) -> Iterator[pa.RecordBatch]:
    """A byte for each pair that was asked for: 0 if its context is unknown, else 1 + ``sure`` * 2 + whether the word is the one predicted."""
    context, after, times = (np.concatenate([s[i] for s in seen] or [np.zeros(0, np.uint64)]) for i in (1, 2, 3))
    order, new, value = _pairs(context, after)
    pair = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    if len(start):
        counts = np.add.reduceat(times[order].astype(np.int64), start)
        begins = np.r_[True, value[start][1:] != value[start][:-1]]
        first = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        total, top = np.add.reduceat(counts, first), np.maximum.reduceat(counts, first)
        # of a context's next words the most frequent, of equally frequent ones that with the least hash
        best = np.flatnonzero(counts == top[group])
        best = best[np.r_[True, group[best][1:] != group[best][:-1]]]
        # a text's own word does not predict itself; if it led alone among others, one of these would be predicted
        own = np.arange(len(counts)) == best[group]
        gone = own & (top[group] == 1)
        code = np.where(total[group] > 1, 1 + 2 * sure(top[group] - (own & ~gone), total[group] - 1) + (own & ~gone), 0).astype(np.uint8)
        back = np.zeros(len(order), np.uint8)
        back[order] = code[pair]
        known, lead, held = value[start[first]], after[order[start[best]]], 1 + 2 * sure(top, total)
    out: dict[int, list[bytes]] = {}
    at = 0
    for chunk, own, *_ in seen:
        out.setdefault(chunk, [b"", b""])[0] = back[at : at + len(own)].tobytes()
        at += len(own)
    for chunk, own, word, _ in asked:
        found = np.zeros(len(own), np.uint8)
        if len(start):
            to = np.minimum(np.searchsorted(known, own), len(known) - 1)
            found = np.where(known[to] == own, held[to] + (lead[to] == word), 0).astype(np.uint8)
        out.setdefault(chunk, [b"", b""])[1] = found.tobytes()
    for chunk, (a, b) in out.items():
        yield _batch([(_home(chunk, parts), chunk, _NEXT, part, _squeezed(a), _squeezed(b))])


def sure(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How often the predicted word came after its context, in 4 steps, and what share of all words there it is, in 5: below 20."""
    return np.searchsorted([2, 3, 5], best, "right") * 5 + np.searchsorted([0.25, 0.5, 0.8, 1.0], best / np.maximum(total, 1), "right")


@dataclass
class Words:
    """What is known of all training words: tokens, different ones, the discount of a count, and the speller."""

    n: int
    v: int
    discount: float
    speller: Speller

    def bits(self, counts: np.ndarray, sizes: np.ndarray, text: bytes) -> np.ndarray:
        """The bits of each word: its discounted share of the training words, and what the discounts leave, spelt."""
        spelt = self.speller.bits(sizes, text)
        if not self.n:
            return spelt
        share = np.maximum(counts - self.discount, 0) / self.n
        known = np.full(len(share), -np.inf)
        np.log2(share, out=known, where=share > 0)
        return -np.logaddexp2(known, np.log2(self.discount * self.v / self.n) - spelt)


def hit_codes(hit: np.ndarray, surely: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The context of each prediction's bit: how sure it is, and whether the text's last two predictions were right."""
    past = np.zeros(len(hit), np.int64)
    for back in (1, 2):
        before = np.zeros(len(hit), np.int64)
        same = text[back:] == text[:-back]
        before[back:] = np.where(same, 1 + hit[:-back], 0)
        past = past * 3 + before
    return surely * _OUTCOMES + past


def repeats(place: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each word came before in its text, how many words did)."""
    n = len(place)
    # texts, words and places in one number each, which a plain sort puts in order
    key = np.sort((doc * (int(place.max(initial=0)) + 1) + place) * n + np.arange(n))
    word, order = np.divmod(key, max(n, 1))
    start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if n else np.zeros(0, np.int64)
    before = np.zeros(n, np.int64)
    before[order] = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    return before, np.arange(n) - np.repeat(ends[:-1], np.diff(ends))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, n_bytes long, bits binary, codes binary"


def _texts(words: Words, parts: int):
    """Sorted messages of chunks to a row a text: its tokens, the base's sum, the bits of the words not predicted at each gate and share, and how often each code's prediction was right and wrong."""

    def scored(texts: tuple, counts: np.ndarray, nexts: list[tuple]) -> pa.RecordBatch:
        known, place, (ids, held, lengths, sizes, letters, text) = texts
        cost, base = words.bits(counts, letters.astype(np.int64), text), np.log10(counts + 0.1)
        ends = np.r_[0, np.cumsum(lengths)]
        doc = np.repeat(np.arange(len(ids)), lengths)
        paid = np.ones(len(place), bool)
        answer = np.zeros(len(place), np.uint8)
        for turn, both in enumerate(_rounds(known[place], held, lengths, list(range(ROUNDS)))):
            for i, (at, pair, *_) in enumerate(both):
                # the ranges' answers, one after the other, are in the order of the pairs
                answer[at] = np.frombuffer(b"".join(n[1 + i] for n in nexts if n[0] // parts == turn), np.uint8)[pair]
        where = np.flatnonzero(answer)
        surely, hit = np.divmod(answer[where].astype(np.int64) - 1, 2)
        hit = hit == 1
        paid[where[hit]] = False
        code = hit_codes(hit.astype(np.int64), surely, doc[where])
        cells, times = np.unique((doc[where] * _CODES + code) * 2 + hit, return_counts=True)
        cut = np.searchsorted(cells, np.arange(len(ids) + 1) * (_CODES * 2))
        codes = [np.column_stack([cells[a:b] - d * _CODES * 2, times[a:b]]).astype(np.int32).tobytes() for d, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))]
        before, inside = repeats(place, doc, ends)
        p, q = np.exp2(-cost[place][paid]), before[paid] / np.maximum(inside[paid], 1)
        cell = doc[paid] * len(_GATES) + np.searchsorted(_GATES, inside[paid], "right") - 1
        bits = np.zeros((len(ids) * len(_GATES), len(SHARES)))
        for i, share in enumerate(SHARES):
            mixed = -np.log2((1 - share) * p + share * q) if share else cost[place][paid]
            bits[:, i] = np.bincount(cell, mixed, len(bits))
        known_ones = np.bincount(doc, counts[place] > 0, len(ids)).astype(np.int64)
        columns = [pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), pa.array(known_ones), pa.array(np.bincount(doc, base[place], len(ids))), pa.array(sizes.astype(np.int64)), pa.array([x.tobytes() for x in bits.reshape(len(ids), -1)], pa.binary()), pa.array(codes, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, counts, nexts = None, None, [], []
        for chunk, kind, part, a, b, c, d in _rows(batches, True):
            if kind == _TEXTS:
                if texts is not None:
                    yield scored(texts, np.concatenate(counts), nexts)
                now, texts, counts, nexts = chunk, _opened(a, b, c, d), [], []
            elif chunk != now:
                raise RuntimeError("A message reached a part without its chunk's texts.")
            elif kind == _COUNTS:
                counts.append(_full(a, 6).astype(np.int64))
            else:
                nexts.append((part, _loosened(a), _loosened(b)))
        if texts is not None:
            yield scored(texts, np.concatenate(counts), nexts)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of bit counts, (part, a), to their sums."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in range(batch.num_rows):
            part, x = batch.column(0)[r].as_py(), _full(batch.column(1)[r].as_buffer(), 4).astype(np.int64)
            total[part] = total[part] + x if part in total else x
    if total:
        # counts beyond 32 bits weigh no more than 32 bits do
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_slim(np.minimum(x, 0xFFFFFFFF), 4) for x in total.values()], pa.binary())], ["part", "a"])


def _letters_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, a, b) of letters in contexts, of all ranges of words, to one row with how often each comes."""
    part, got = 0, []
    for batch in batches:
        for r in range(batch.num_rows):
            part = batch.column(0)[r].as_py()
            got.append((unplanes(batch.column(1)[r].as_py()), _full(batch.column(2)[r].as_py(), 6)))
    if got:
        pairs, _, place = _distinct(np.concatenate([x for x, _ in got]))
        times = np.bincount(place, np.concatenate([x for _, x in got]).astype(np.float64), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([planes(pairs)], pa.binary()), pa.array([_slim(times, 6)], pa.binary())], ["part", "a", "b"])


def _fitted(speller: Speller):
    """(part, a, b) of letters in contexts to (part, sums): what a pass over them gives, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = pickle.loads(pickle.dumps(speller.mixer))
                sums = Speller(speller.counts, own).fit_pairs(unplanes(batch.column(1)[r].as_py()), _full(batch.column(2)[r].as_py(), 6))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    return run


def _fits_summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sums in order of their parts to one row of their sum."""
    part, total = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            part, x = batch.column(0)[r].as_py() if part is None else part, np.frombuffer(batch.column(1)[r].as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def _sum_of_fits(fits: DataFrame, parts: int) -> np.ndarray:
    """The sum of packed rows of numbers, (part, sums): tasks add up a root of the parts each, in order, and the driver one row of each task."""
    few = max(1, round(parts**0.5))
    some = fits.repartitionById(few, F.pmod("part", F.lit(few))).sortWithinPartitions("part").mapInArrow(lean(_fits_summed), "part int, sums binary")
    return sum(np.frombuffer(x, np.float64) for _, x in sorted(some.collect()))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bits, codes) of texts to sums: how often each code was wrong (cell 2 * code) and right (2 * code + 1), then the bits at each gate and share."""
    hits, bits = np.zeros(_CODES * 2, np.int64), np.zeros(len(_GATES) * len(SHARES))
    for batch in batches:
        cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, 2)
        hits += np.bincount(cells[:, 0], cells[:, 1], _CODES * 2).astype(np.int64)
        bits += np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, len(bits)).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hits) + len(bits))), pa.array(np.r_[hits.astype(float), bits])], ["cell", "sum"])


def fit_hits(counts: np.ndarray, passes: int = 200) -> np.ndarray:
    """The probability that a prediction is right, by code, from how often each code's was wrong and right (codes, 2).

    Three predictors, of how sure the context is, of the text's last predictions and of both, are mixed by weights gated by how
    often the predicted word came; the curve of a code refines the mix.
    """
    code = np.arange(_CODES)
    views = [code // _OUTCOMES, code % _OUTCOMES, code]
    sums = [np.stack([np.bincount(v, counts[:, b], _CODES) for b in (0, 1)], axis=1)[v] for v in views]
    inputs = np.stack([stretch((s[:, 1] + 0.4) / (s.sum(axis=1) + 0.8)) for s in sums] + [np.full(_CODES, 0.3)], axis=1)
    mixer, gate = Mixer(4, inputs.shape[1], _CODES), code // (5 * _OUTCOMES)
    weight = counts / max(1, counts.sum())
    for _ in range(passes):
        for bit in (0, 1):
            mixer.learn(inputs, gate, code, np.full(_CODES, bit), weight[:, bit] * 1000)
    return mixer.predict(inputs, gate, code)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_every: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): the log10 probability of every whole text.

    Tokens are the words of the text, A-Z lowered, and an end. Texts whose ``crc32(id as text)`` is divisible by ``held_every`` are held
    out, the model learns from the others. The base is the unigram with 0.1 added to every count.

    The model codes each token by bits. Where the ORDER words before are known from training texts, the first bit
    says whether the word is the one that most often came after them there. Its probability is mixed from
    predictors in hashed contexts: how often and how surely that word came, how the text's last predictions went, and
    both; an own word does not count for its text. Where it is not predicted, a word's probability is mixed of its share of the text so
    far, by a weight gated by the place in the text, and of its discounted share of the training words plus, from what the discounts leave, its spelling: the bits of its letters, each mixed from the counts of 1 to LETTERS letters before it,
    hashed to SLOTS places, over all training words, each once. In both, weights are gated and learnt online, and a
    curve a context refines what they give. ``bits_per_byte`` is the whole cost by the text's bytes.

    Counts, contexts and curves of predictions come from all training texts: chunks of texts, stored as places in lists of words, send their distinct words and contexts to
    ranges of hashes and get counts back, contexts in ROUNDS rounds. A hot word or context is one entry a chunk (a context one a next word). The spelling's weights are fitted on all training words: their letters in contexts, with how often each comes, are
    dealt to tasks, and in each of FITS rounds the tasks' weights are averaged and their curves summed. Null and empty texts are an end alone. A null id is not held out. Rows that repeat an id are texts
    of their own. Without training texts every count is 0 and words are spelt by even bits. No rows give none; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing-contexts")
    parts = max(parts_for(docs), 2)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % held_every == 0, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = scratch.table(rows.mapInArrow(lean(_chunks(parts)), _MESSAGE), "chunks")
    numbers = {c: F.sum(c) for c in ("n", "v", "once", "twice")}
    sent = chunks.mapInArrow(lean(_deal_words(parts)), _MESSAGE).repartitionById(parts, "to")
    found = scratch.table(sent.mapInArrow(lean(_count_words(parts)), _MESSAGE), "words", compression="zstd", **numbers)
    n, v, once, twice = (scratch.seen["words"][c] or 0 for c in numbers)
    answers = found.where(F.col("kind") == _COUNTS)
    for turn in range(ROUNDS):
        sent = chunks.mapInArrow(lean(_deal_contexts(parts, turn)), _MESSAGE).repartitionById(parts, "to")
        answers = answers.unionAll(scratch.table(sent.mapInArrow(lean(_follow_contexts(parts, turn)), _MESSAGE), f"next-{turn}"))
    tables = found.where((F.col("kind") == _TABLE) & (F.col("part") < LETTERS)).select("part", "a")
    summed = tables.mapInArrow(lean(_added), "part int, a binary").repartitionById(LETTERS, "part").mapInArrow(lean(_added), "part int, a binary").collect()
    counts = np.zeros((LETTERS, SLOTS, 2), np.uint32)
    for part, a in summed:
        counts[part] = _full(a, 4).reshape(SLOTS, 2)
    speller = Speller(counts, Mixer(27, LETTERS + 1, 256))
    letters = found.where(F.col("kind") == _LETTERS).select("to", "a", "b").repartitionById(parts, "to")
    letters = scratch.table(letters.mapInArrow(lean(_letters_summed), "part int, a binary, b binary"), "letters", "zstd")
    for _ in range(FITS if scratch.rows("letters") else 0):
        speller.take(_sum_of_fits(letters.mapInArrow(lean(_fitted(speller)), "part int, sums binary"), parts))
    words = Words(n, v, min(max(once / max(1, once + 2 * twice), 0.05), 0.95), speller)
    own = chunks.unionAll(answers).repartitionById(parts, "to").sortWithinPartitions("chunk", "kind", "part")
    texts = scratch.table(own.mapInArrow(lean(_texts(words, parts)), _SCORED), "texts")
    scratch.keep("texts")
    cells = np.zeros(_CODES * 2 + len(_GATES) * len(SHARES))
    # as many rows as there are cells
    for cell, total in texts.where(~F.col("held_out")).select("bits", "codes").mapInArrow(lean(_summed), "cell long, sum double").groupBy("cell").agg(F.sum("sum")).collect():
        cells[cell] = total
    right = fit_hits(cells[: _CODES * 2].reshape(_CODES, 2))
    price = -np.log2(np.column_stack([1 - right, right])).ravel()
    shares = cells[_CODES * 2 :].reshape(len(_GATES), len(SHARES)).argmin(axis=1)
    level = np.log10(n + 0.1 * (v + 1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tokens, size = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (4, 2, 5))
            bits = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.float64).reshape(-1, len(_GATES), len(SHARES))[:, np.arange(len(_GATES)), shares].sum(axis=1)
            for r, raw in enumerate(batch.column(7).to_pylist()):
                cells = np.frombuffer(raw, np.int32).reshape(-1, 2)
                bits[r] += (price[cells[:, 0]] * cells[:, 1]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(batch.num_rows, n)), pa.array(base - tokens * level), pa.array(-bits * np.log10(2)), pa.array(bits / np.maximum(size, 1))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.mapInArrow(lean(finish), kind).withColumnRenamed("id", id_col)
