"""Secrets in texts: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import blocks, by_text, free_memory, in_one_task, range_hashes

# The patterns, the group that is the value, and its least length.
PATTERNS = [
    (
        "assign",
        re.compile(
            rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            re.IGNORECASE,
        ),
        2,
        6,
    ),
    ("access", re.compile(rb"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(rb"[0-9a-f]+"), 0, 24),
]
KEY_WORD = re.compile(rb"password|passwd|secret|token|api|key", re.IGNORECASE)
#: The kind of spans that only the random field finds; kinds sort in this order.
LEARNED = "crf"
KINDS = [kind for kind, *_ in PATTERNS] + [LEARNED]

#: Bounds of the training sample: texts likely to have a match, other texts, bytes of each.
SAMPLE_WITH, SAMPLE_WITHOUT, SAMPLE_BYTES = 400, 200, 20_000
AROUND = 12  # tokens on each side of a match that training takes
#: Altered copies of a text with matches, and places with odd tokens that training takes of a text.
ALTERED, ODD_PLACES = 6, 4
EPOCHS = 50
# Signs before a value, and alphabets of values with their least and greatest length.
SIGNS = [b" = ", b": ", b"=", b" ", b" ", b" ", b" is ", b' = "', b': "', b" '", b"\n"]
ALPHABETS = [
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 16, 48),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 24, 64),
    ("abcdefghijklmnopqrstuvwxyz0123456789", 18, 40),
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 18, 40),
    ("0123456789abcdef", 20, 64),
]

OUTSIDE, BEGIN, INSIDE = range(3)

_TOKEN = np.zeros(256, dtype=bool)
for _chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"+/_-"):
    _TOKEN[list(_chars)] = True
_TOKEN[128:] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
# of each byte: 1 lower case, 2 upper case, 4 digit, 8 sign, 16 not ASCII
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 4
_CLASS[list(b"+/_-")], _CLASS[128:] = 8, 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

LENGTHS = np.array([3, 5, 8, 12, 16, 20, 24, 32, 40])
TURNS = np.array([1, 2, 3, 5, 8])
N_SHAPE = (len(LENGTHS) + 1) * 32 * (len(TURNS) + 1) * 2
N_GAP, N_WORD, N_FILE = 16, 4096, 64


def base_matches(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, place of the kind, end, value start, value end) in bytes, by start and then kind."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, m.end(), m.start(group), m.end(group)))
    return sorted(found)


class Tokens:
    """Tokens of touching texts, and for each its features as numbers of one table.

    A token is a run of letters, digits and + / _ -. Features: its shape (length, kinds of
    characters, changes between them, all hex), what stands before it (line end, blank,
    : or =, quote), the word before that, its own first letters, and the file's size and
    share of tokens with digits.
    """

    FEATURES = N_SHAPE + N_GAP + 2 * N_WORD + N_FILE

    def __init__(self, data: bytes, offsets: np.ndarray):
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = _TOKEN[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.start, offsets)  # first token of each text
        k = len(self.start)
        self.mixed = np.zeros(k, dtype=bool)  # tokens of letters and digits
        if not k:
            self.features = np.zeros((0, 5), dtype=np.int64)
            return
        start, end = self.start, self.end
        kind = _CLASS[raw]

        def counted(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(flags, out=sums[1:], dtype=np.int32)
            return sums

        length = end - start
        shape = np.zeros(k, dtype=np.int64)
        for bit in (1, 2, 4, 8, 16):
            sums = counted(kind == bit)
            shape |= np.where(sums[end] > sums[start], bit, 0)
        self.mixed = (shape & 4 > 0) & (shape & 3 > 0)
        hexed = counted(_HEX[raw])
        hexed = hexed[end] - hexed[start] == length
        change = np.zeros(n, dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        change = counted(change)
        turns = change[end] - change[np.minimum(start + 1, end)]
        sizes = np.searchsorted(LENGTHS, length, "right")
        turn = np.searchsorted(TURNS, turns, "right")
        whole = ((sizes * 32 + shape) * (len(TURNS) + 1) + turn) * 2 + hexed

        text = np.searchsorted(self.first, np.arange(k), "right") - 1
        fresh = np.zeros(k, dtype=bool)
        fresh[self.first[self.first < k]] = True
        before = np.where(fresh, offsets[text], np.concatenate(([0], end[:-1])))
        gap = fresh.astype(np.int64) * 8
        for bit, chars in ((1, b"\n\r"), (2, b":="), (4, b"\"'")):
            flags = np.zeros(256, dtype=bool)
            flags[list(chars)] = True
            sums = counted(flags[raw])
            gap |= np.where(sums[start] > sums[before], bit, 0)
        low = _FOLD[raw]
        words = range_hashes(low, start, end) & np.uint64(N_WORD - 1)
        previous = np.concatenate(([0], words[:-1])).astype(np.int64)
        previous[fresh] = 0
        head = range_hashes(raw, start, np.minimum(end, start + 4)) & np.uint64(N_WORD - 1)
        size = np.diff(self.first)
        digits = np.zeros(k + 1, dtype=np.int64)
        np.cumsum((shape & 4) > 0, out=digits[1:])
        share = (digits[self.first[1:]] - digits[self.first[:-1]]) / np.maximum(size, 1)
        sort = np.minimum(15, np.log2(np.maximum(size, 1)).astype(np.int64)) * 4
        sort += np.searchsorted([0.01, 0.05, 0.2], share, "right")
        columns = [whole, gap, previous, head.astype(np.int64), sort[text]]
        at = np.cumsum([0, N_SHAPE, N_GAP, N_WORD, N_WORD])
        self.features = np.stack([c + a for c, a in zip(columns, at)], axis=1)


class RandomField:
    """Linear-chain conditional random field over the labels outside, begin and inside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (feature, label), (label, next label)

    @classmethod
    def fit(cls, examples: list[tuple[np.ndarray, np.ndarray]]) -> RandomField:
        """By adaptive gradient steps on the likelihood of sequences (features, labels)."""
        weights, moves = np.zeros((Tokens.FEATURES, 3)), np.zeros((3, 3))
        squares, move_squares = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
        parts = [_padded(part) for part in _by_length(examples)]
        for _ in range(EPOCHS):
            grad, move_grad = np.zeros_like(weights), np.zeros_like(moves)
            for features, gold, mask in parts:
                slope, change = _slopes(weights[features].sum(axis=2), moves, gold, mask)
                for label in range(3):
                    each = np.repeat(slope[:, :, label].ravel(), features.shape[2])
                    grad[:, label] += np.bincount(features.ravel(), each, Tokens.FEATURES)
                move_grad += change
            grad = grad / len(examples) + 1e-5 * weights
            move_grad = move_grad / len(examples) + 1e-5 * moves
            squares += grad**2
            move_squares += move_grad**2
            weights -= 0.5 * grad / np.sqrt(squares)
            moves -= 0.5 * move_grad / np.sqrt(move_squares)
        return cls(weights, moves)

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of all tokens (Viterbi); ``first`` has the first token of each text.

        A token whose outside score leads by more than any change of moves could make up is
        outside on every best path, so only the runs between such tokens are searched, all
        runs of a length at once.
        """
        n, moves = len(features), self.moves
        labels = np.zeros(n, dtype=np.int8)
        emit = np.zeros((n, 3))
        for column in features.T:
            emit += self.weights[column]
        around = moves[:, None, :] + moves.T[None, :, :]  # from, to, label between
        gain = max(
            (around[:, :, 1:] - around[:, :, :1]).max(),
            (moves[:, 1:] - moves[:, :1]).max(),
            (moves[1:] - moves[:1]).max(),
            0.0,
        )
        open_ = emit[:, OUTSIDE] - emit[:, 1:].max(axis=1) <= gain
        places = np.flatnonzero(open_)
        if not len(places):
            return labels
        edge = np.zeros(n + 1, dtype=bool)
        edge[first] = True
        starts = np.ones(len(places), dtype=bool)
        starts[1:] = (places[1:] != places[:-1] + 1) | edge[places[1:]]
        run_start = places[starts]
        run_length = np.diff(np.append(np.flatnonzero(starts), len(places)))
        for length in np.unique(run_length).tolist():
            at = run_start[run_length == length]
            score = emit[at] + np.where(edge[at][:, None], 0.0, moves[OUTSIDE])
            back = np.zeros((length, len(at), 3), dtype=np.int8)
            for t in range(1, length):
                step = score[:, :, None] + moves
                back[t] = step.argmax(axis=1)
                score = step.max(axis=1) + emit[at + t]
            score = score + np.where(edge[at + length][:, None], 0.0, moves[:, OUTSIDE])
            best = score.argmax(axis=1)
            for t in range(length - 1, -1, -1):
                labels[at + t] = best
                best = back[t][np.arange(len(at)), best]
        return labels


def _by_length(examples, most: int = 1 << 13):
    """Sequences of about equal length together, so many that padded they have ``most`` tokens."""
    part = []
    for example in sorted(examples, key=lambda e: len(e[1])):
        if part and (len(part) + 1) * len(example[1]) > most:
            yield part
            part = []
        part.append(example)
    if part:
        yield part


def _padded(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels one-hot, mask) of sequences filled up to the longest."""
    steps = len(part[-1][1])
    features = np.zeros((len(part), steps, 5), dtype=np.int32)
    gold, mask = np.zeros((len(part), steps, 3)), np.zeros((len(part), steps), dtype=bool)
    for i, (own, labels) in enumerate(part):
        features[i, : len(own)], mask[i, : len(own)] = own, True
        gold[i, np.arange(len(own)), labels] = 1
    return features, gold, mask


def _slopes(emit: np.ndarray, moves: np.ndarray, gold: np.ndarray, mask: np.ndarray):
    """Gradients of the negative log likelihood by emission (sequence, place, label) and by move."""
    rows, steps, _ = emit.shape
    ahead, back = np.zeros(emit.shape), np.zeros(emit.shape)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, steps):
        step = _log_sum(ahead[:, t - 1][:, :, None] + moves, 1) + emit[:, t]
        ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    for t in range(steps - 2, -1, -1):
        step = _log_sum(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where(mask[:, t + 1, None], step, back[:, t + 1])
    odds = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
    joint = ahead[:, :-1, :, None] + moves + (emit + back)[:, 1:, None, :] - total[:, None, None, None]
    joint = np.exp(np.minimum(joint, 0))
    seen = gold[:, :-1, :, None] * gold[:, 1:, None, :]
    change = (joint - seen) * mask[:, 1:, None, None]
    return odds - gold, change.sum(axis=(0, 1))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def altered(text: bytes, rng: random.Random) -> tuple[bytes, list[tuple[int, int]]]:
    """The text with other words, signs and values in place of its matches, and where values stand.

    What the patterns look for is gone from it, so that a field cannot learn their key words
    alone: it must tell a secret by its shape and by how it stands in the text.
    """
    words = [w for w in re.findall(rb"[A-Za-z]{3,}", text) if not KEY_WORD.search(w)] or [b"value"]
    out, places, at, size = [], [], 0, 0
    for start, _, end, a, b in base_matches(text):
        if start < at:
            continue
        value = text[a:b]
        if len(value) < 16 or rng.random() < 0.7:
            value = _value(rng)
        lead = text[at:start] + rng.choice(words) + rng.choice(SIGNS)
        out += [lead, value]
        size += len(lead)
        places.append((size, size + len(value)))
        size += len(value)
        at = end
    out.append(text[at:])
    return b"".join(out), places


def _value(rng: random.Random) -> bytes:
    """A made-up secret: some characters of an alphabet, sometimes after short words."""
    alphabet, least, most = rng.choice(ALPHABETS)
    value = "".join(rng.choices(alphabet, k=rng.randint(least, most)))
    for _ in range(rng.choice((0, 0, 0, 1, 2))):
        value = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 4))) + "_" + value
    return value.encode()


def _examples(text: bytes, places: list[tuple[int, int]], rng: random.Random):
    """(features, labels) of the tokens around the places, and of some odd tokens elsewhere."""
    tokens = Tokens(text, np.array([0, len(text)]))
    n = len(tokens.start)
    labels = np.zeros(n, dtype=np.int64)
    wanted = np.zeros(n, dtype=bool)
    for a, b in places:
        i, j = np.searchsorted(tokens.end, a, "right"), np.searchsorted(tokens.start, b)
        labels[i:j] = INSIDE
        labels[i : min(i + 1, j)] = BEGIN
        wanted[max(0, i - AROUND) : j + AROUND] = True
    # tokens that are long or mixed, and no secrets: what a field would mistake for one
    odd = np.flatnonzero(~wanted & ((tokens.end - tokens.start >= 12) | tokens.mixed))
    odd = odd.tolist() if n else []
    for i in rng.sample(odd, min(len(odd), ODD_PLACES)):
        wanted[max(0, i - 4) : i + 5] = True
    if n and not wanted.any():
        i = rng.randrange(n)
        wanted[max(0, i - 2 * AROUND) : i + 2 * AROUND] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([0], wanted.astype(int), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        for c in range(a, b, 64):
            yield tokens.features[c : min(b, c + 64)].astype(np.int32), labels[c : min(b, c + 64)]


def train(texts: list[bytes]) -> RandomField | None:
    """A field whose examples are the values of base matches; None without a match.

    Each text with matches counts as it is and ``ALTERED`` times with other words, signs and
    values in place of the matches.
    """
    parts = []
    for text in texts:
        rng = random.Random(zlib.crc32(text))
        places = [(a, b) for _, _, _, a, b in base_matches(text)]
        parts += _examples(text, places, rng)
        for _ in range(ALTERED if places else 0):
            parts += _examples(*altered(text, rng), rng)
    if not any(own.any() for _, own in parts):
        return None
    return RandomField.fit(parts)


def training_texts(docs: DataFrame) -> DataFrame:
    """(text): the bounded training sample, the same for the same documents in any order.

    Hashes of texts are picked first, so that tasks send hashes, not texts, to choose from.
    """
    likely = F.col("text").rlike(
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    )
    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text")
    keyed = short.withColumn("key", F.xxhash64("text"))

    def least(rows: DataFrame, most: int) -> DataFrame:
        return rows.select("key").distinct().orderBy("key").limit(most)

    # both are bounded by their limits
    picked = least(keyed.where(likely), SAMPLE_WITH).union(least(keyed, SAMPLE_WITHOUT)).distinct()
    return keyed.join(F.broadcast(picked), "key").dropDuplicates(["key"]).select("text")


def _trained(rows: pa.Table) -> tuple[np.ndarray, np.ndarray] | None:
    field = train(sorted(t.encode() for t in rows["text"].to_pylist()))
    return None if field is None else (field.weights, field.moves)


def secret_scan(docs: DataFrame, field: RandomField | None = None) -> DataFrame:
    """Documents (doc_id, text, others kept) with the secrets found in each.

    Adds n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, by
    start and kind, comma-joined) and masked, the text with each span as ``[SECRET]``. The
    patterns of ``PATTERNS`` give the base spans. The field, trained on a bounded sample of
    the documents that the patterns label unless one is given, tags the tokens of every
    whole text; what it tags beyond the base spans, without touching one, is added.

    Null text counts as empty and stays null in masked; no match gives zeros, an empty spans
    and the digest of the empty string. Columns of these names are replaced. Repeated rows
    and null doc_ids come back as they are; no documents give no rows. Without any base
    match in the sample no field is trained. Memory: the sample in one task, of which the
    driver gets the field; in the others a block of 1 MiB of text, or one longer text, and
    its tokens.
    """
    if field is None:
        fitted = in_one_task(_trained, training_texts(docs))
        field = None if fitted is None else RandomField(*fitted)
        free_memory(docs.sparkSession)
    found = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked"]
    docs = docs.drop(*found)
    at = docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = (
        f"{fields}, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, spans string, masked string"
    )

    def run(batch):
        text = batch.column(at)
        for first, end, data, offsets in blocks(text):
            learned = _learned(field, data, offsets)
            rows = [
                _row(data[a:b], own)
                for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), learned)
            ]
            part = batch.slice(first, end - first)
            counts, digests, spans, masked = zip(*rows)
            masked = [m if t else None for m, t in zip(masked, part.column(at).is_valid().to_pylist())]
            added = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(PATTERNS))]
            added += [pa.array(x, pa.string()) for x in (digests, spans, masked)]
            yield pa.record_batch([*part.columns, *added], [*batch.schema.names, *found])

    return by_text(run, docs, schema)


def _learned(field: RandomField | None, data: bytes, offsets: np.ndarray):
    """Spans (start, end) in bytes that the field tags, for each text."""
    found = [[] for _ in range(len(offsets) - 1)]
    if field is None or not data:
        return found
    tokens = Tokens(data, offsets)
    labels = field.decode(tokens.features, tokens.first)
    for i in np.flatnonzero(labels != OUTSIDE).tolist():
        text = int(np.searchsorted(tokens.first, i, "right")) - 1
        a, b = int(tokens.start[i] - offsets[text]), int(tokens.end[i] - offsets[text])
        own = found[text]
        if labels[i] == INSIDE and own and own[-1][2] == i - 1:
            own[-1] = (own[-1][0], b, i)
        else:
            own.append((a, b, i))
    return [[(a, b) for a, b, _ in own] for own in found]


def _row(text: bytes, learned: list[tuple[int, int]]):
    base = base_matches(text)
    spans = [(a, rank, b) for a, rank, b, _, _ in base]
    ends, reach = [], 0  # the greatest end of the base spans up to each
    for _, _, e in spans:
        reach = max(reach, e)
        ends.append(reach)
    starts = [a for a, _, _ in spans]
    for a, b in learned:
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if not before or ends[before - 1] <= a:
            spans.append((a, len(PATTERNS), b))
    spans.sort()
    counts = [sum(rank == r for _, rank, *_ in base) for r in range(len(PATTERNS))]
    if not spans:
        return counts, hashlib.sha256(b"").hexdigest(), "", text.decode()
    points = np.zeros(len(text) + 1, dtype=np.int64)
    np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80, out=points[1:])

    def written(rows) -> str:
        return ",".join(f"{KINDS[rank]}:{points[a]}:{points[b]}" for a, rank, b in rows)

    masked, done = [], 0
    for a, _, b in spans:
        if a >= done:
            masked += [text[done:a], b"[SECRET]"]
        done = max(done, b)
    masked.append(text[done:])
    digest = hashlib.sha256(written([s for s in spans if s[1] < len(PATTERNS)]).encode()).hexdigest()
    return counts, digest, written(spans), b"".join(masked).decode()
