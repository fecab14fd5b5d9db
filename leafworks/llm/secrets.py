"""Secret scans: base patterns and a linear-chain conditional random field."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import small_batches, table
from .words import U64, Words, utf8

# The base patterns, the lengths below which matches are dropped, and the kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

#: Documents that the field is trained on at most: those with the least hashed ids.
TRAIN_ROWS = 6_000

Span = tuple[int, int, int]  # start, end, number of the kind


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping per kind, short ones dropped."""
    low = text.lower()
    found: list[Span] = []
    if any(k in low for k in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), 2) for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


#: A maximal run of hex digits either has LEAST or is dropped, so the count can stand in the pattern.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")

# Token characters: letters, digits and + / _ . - and all of non-ASCII; other signs and blanks part tokens.
SEPARATORS = np.array([b < 128 and not (chr(b).isalnum() or chr(b) in "+/_.-") for b in range(256)])
LOWERS, UPPERS, DIGITS = (np.array([b < 128 and test(chr(b)) for b in range(256)]) for test in (str.islower, str.isupper, str.isdigit))
HEXES = np.array([b < 128 and chr(b) in "0123456789abcdef" for b in range(256)])
SIGNS = np.array([b < 128 and chr(b) in "+/_.-" for b in range(256)])
ASSIGNS = np.array([b < 128 and chr(b) in "=:" for b in range(256)])
QUOTES = np.array([b < 128 and chr(b) in "\"'" for b in range(256)])
NEWLINES = np.arange(256) == 10

STATES = 3  # outside, begin, inside
#: Shape and place of a token, one weight each.
FEATURES = (
    "one", "length 12", "length 16", "length 20", "length 32", "length 40", "length 64", "half digits", "no upper", "no lower", "mixed case and digit", "all hex", "signs", "dots",
    "3 kind changes", "6 kind changes", "10 kind changes", "plain word", "mixed shape", "quote after", "line end after", "dot at the end", "after a cue and its sign", "assignment before", "quote before", "same line before", "assignment after", "non-ASCII", "file: many assignments", "file: many digits",
)
#: Named by hash, a weight for each of BUCKETS: the words before and after, and the token's first bytes.
HASHED, BUCKETS = ("word before", "second word before", "word after", "first 3 bytes", "first 4 bytes"), 1 << 13


def _counts(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[b] - total[a]


def mixed(words: Words) -> np.ndarray:
    """The numbers of the tokens of 8 bytes or more with digits and letters, or 20 or more with both cases."""
    raw, s, e = words.raw, words.start, words.end
    long = np.flatnonzero(e - s >= 8)
    lower, upper, digit = (_counts(m[raw], s[long], e[long]) for m in (LOWERS, UPPERS, DIGITS))
    return long[((digit > 0) & (lower + upper > 0)) | ((e - s)[long] >= 20) & (lower > 0) & (upper > 0)]


#: Tokens before and after a token that calls for a look, which are trained on with it.
BEFORE, AFTER = 3, 14


def windows(words: Words) -> np.ndarray:
    """The numbers of the tokens whose chains are trained on: those from BEFORE before to AFTER after each mixed token and each cue, in the same text."""
    calls = np.union1d(mixed(words), cues(words))
    n = len(words.start)
    if not len(calls):
        return calls
    text = words.text_of()[calls]
    low, high = np.maximum(calls - BEFORE, words.first[text]), np.minimum(calls + AFTER + 1, words.first[text + 1])
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.flatnonzero(np.cumsum(step[:-1]) > 0)


#: Tokens of a stretch of plain text for training.
PLAIN = 24


def plain(words: Words) -> np.ndarray:
    """The numbers of the tokens of a stretch of each text, somewhere by its length, but those of windows()."""
    first = words.first[:-1] + (words.count * 40_503 // 16) % np.maximum(words.count - PLAIN + 1, 1)
    step = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(first + PLAIN, words.first[1:]), -1)
    return np.setdiff1d(np.flatnonzero(np.cumsum(step[:-1]) > 0), windows(words), assume_unique=True)


def features(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens numbered at: a row of FEATURES, and the buckets of HASHED."""
    raw, text = words.raw, words.text_of()
    s, e, of = words.start[at], words.end[at], text[at]
    size = e - s
    lower, upper, digit, hexa, sign = (_counts(m[raw], s, e) for m in (LOWERS, UPPERS, DIGITS, HEXES, SIGNS))
    wide, dots = _counts(raw >= 128, s, e), _counts(raw == 46, s, e)
    kind = (LOWERS * 1 + UPPERS * 2 + DIGITS * 3 + SIGNS * 4)[raw]
    changes = _counts(np.concatenate([[False], kind[1:] != kind[:-1]]), np.minimum(s + 1, e), e)
    n = len(words.start)

    def near(by: int) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours' numbers, and which are of the same text."""
        to = np.clip(at + by, 0, n - 1)
        return to, (at + by == to) & (text[to] == of)

    prev, has_prev = near(-1)
    after, has_after = near(1)
    before = np.where(has_prev, words.end[prev], words.at[:-1][of])
    behind = np.where(has_after, words.start[after], words.at[1:][of])
    assign, quote, line = (_counts(m[raw], before, s) > 0 for m in (ASSIGNS, QUOTES, NEWLINES))
    assign_after, quote_after, line_after = (_counts(m[raw], e, behind) > 0 for m in (ASSIGNS, QUOTES, NEWLINES))
    count = np.maximum(words.count, 1)
    odd = np.zeros(n, dtype=bool)
    odd[mixed(words)] = True
    per_text = [_counts(m[raw], words.at[:-1], words.at[1:]) for m in (ASSIGNS, DIGITS)]
    dense = np.stack(
        [np.ones(len(at), dtype=bool), size >= 12, size >= 16, size >= 20, size >= 32, size >= 40, size >= 64, 2 * digit >= size, upper == 0, lower == 0, (upper > 0) & (lower > 0) & (digit > 0), hexa == size, sign > 0, dots > 0,
         changes >= 3, changes >= 6, changes >= 10, lower == size, odd[at], quote_after, line_after, raw[e - 1] == 46, after_cue(words)[at], assign, quote, ~line & has_prev, assign_after, wide > 0, (per_text[0] > 0.1 * count)[of], (per_text[1] > 0.5 * count)[of]],
        axis=1,
    )
    buckets = np.zeros((len(at), len(HASHED)), dtype=np.int64)
    for i, by in enumerate((-1, -2, 1)):
        to, ok = near(by)
        h = words.only(to).hashes(lower=True, seed=i)
        # a word on another line, or none, is no cue
        buckets[:, i] = np.where(ok & ~(line if by < 0 else np.zeros(len(at), dtype=bool)), h % U64(BUCKETS), i)
    for i, k in ((3, 3), (4, 4)):
        head = words.only(at)
        head.end = np.minimum(head.start + k, head.end)
        buckets[:, i] = head.hashes(seed=i) % U64(BUCKETS)
    return dense, buckets


@dataclass
class Field:
    """Weights of the features for each state, and of each step from state to state (0: also before and after a chain)."""

    emit: np.ndarray
    hashed: np.ndarray
    step: np.ndarray

    def emissions(self, x: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        # tasks (x of flags) go without BLAS, whose threads would take more than a core
        score = np.einsum("ij,kj->ik", x.astype(np.float64), self.emit) if x.dtype == bool else x @ self.emit.T
        for i in range(buckets.shape[1]):
            score += self.hashed[i][buckets[:, i]]
        return score

    def unsure(self, score: np.ndarray) -> np.ndarray:
        """Which tokens may be other than outside on a best path. The others' emissions are higher outside by more than any steps to and from begin or inside could make up, whatever stands around them."""
        to, away = self.step[:, None, 1:], self.step[1:].T[None]
        gain = (to + away - self.step[:, 0][:, None, None] - self.step[0][None, :, None]).max()
        return score[:, 0] - score[:, 1:].max(axis=1) <= gain + 1e-9

    def decode(self, score: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The best states of chains by Viterbi. score: emissions, chains end to end; begins: where each starts."""
        out = np.zeros(len(score), dtype=np.int8)
        if not len(score):
            return out
        size = np.diff(np.append(begins, len(score)))
        order = np.argsort(-size, kind="stable")
        begins, size = begins[order], size[order]
        back = np.zeros((size[0], len(size), STATES), dtype=np.int8)
        ends = self.step[0] + score[begins]
        for t in range(1, size[0]):
            live = int(np.searchsorted(-size, -t, side="left"))
            ways = ends[:live, :, None] + self.step[None]
            back[t, :live] = ways.argmax(axis=1)
            ends[:live] = ways.max(axis=1) + score[begins[:live] + t]
        state = (ends + self.step[:, 0]).argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left")) if t else len(size)
            out[begins[:live] + t] = state[:live]
            if t:
                state[:live] = back[t, np.arange(live), state[:live]]
        return out


def chains(words: Words, at: np.ndarray) -> np.ndarray:
    """Where, among the tokens numbered at, runs of neighbours in one text begin; each run is a chain."""
    text = words.text_of()[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    return np.flatnonzero(new)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward sums over chains of one length, score (chains, length, states): log of the sum over all paths, states' probabilities, and
    the expected number of each step, first and last ones from and to outside.
    """
    length = score.shape[1]
    forward, backward = np.empty_like(score), np.empty_like(score)
    forward[:, 0] = step[0] + score[:, 0]
    for t in range(1, length):
        forward[:, t] = _log_sum(forward[:, t - 1, :, None] + step[None], 1) + score[:, t]
    backward[:, -1] = step[:, 0]
    for t in range(length - 2, -1, -1):
        backward[:, t] = _log_sum(step[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
    total = _log_sum(forward[:, -1] + step[:, 0], 1)
    p = np.exp(forward + backward - total[:, None, None])
    pairs = np.exp(forward[:, :-1, :, None] + step[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    steps = pairs.sum(axis=(0, 1))
    steps[0] += p[:, 0].sum(axis=0)
    steps[:, 0] += p[:, -1].sum(axis=0)
    return total, p, steps


def train_field(x: np.ndarray, buckets: np.ndarray, y: np.ndarray, begins: np.ndarray, rounds: int = 80, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by forward-backward sums and Adagrad; chains of tokens end to end."""
    field = Field(np.zeros((STATES, x.shape[1])), np.zeros((buckets.shape[1], BUCKETS, STATES)), np.zeros((STATES, STATES)))
    field.emit[0, 0] = 1.0
    x, size = x.astype(np.float64), np.diff(np.append(begins, len(x)))
    by_size = [begins[size == n][:, None] + np.arange(n) for n in np.unique(size)]
    hot, gold = np.eye(STATES)[y], np.zeros((STATES, STATES))
    for at in by_size:
        path = np.concatenate([np.zeros((len(at), 1), dtype=y.dtype), y[at], np.zeros((len(at), 1), dtype=y.dtype)], axis=1)
        np.add.at(gold, (path[:, :-1], path[:, 1:]), 1)
    weights = (field.emit, field.hashed, field.step)
    seen = [np.full_like(w, 1e-8) for w in weights]
    for _ in range(rounds):
        score, p, steps = field.emissions(x, buckets), np.empty((len(x), STATES)), np.zeros((STATES, STATES))
        for at in by_size:
            _, p[at], more = marginals(score[at], field.step)
            steps += more
        off, n = hot - p, len(begins)
        hashed = np.stack([np.stack([np.bincount(buckets[:, i], weights=off[:, c], minlength=BUCKETS) for c in range(STATES)], axis=1) for i in range(buckets.shape[1])])
        for w, grad, sums in zip(weights, ((off.T @ x) / n, hashed / n, (gold - steps) / n), seen, strict=True):
            grad = grad - decay * w
            sums += grad**2
            w += rate * grad / np.sqrt(sums)
    return field


# What the training plants. Cues stand before secrets, other words before look-alikes.
CUES = (
    "auth", "authorization", "bearer", "key", "access_key", "private_key", "client_key", "signing_key", "encryption_key", "license_key", "client_id", "credential", "credentials", "pwd", "pass",
    "passphrase", "phrase", "mnemonic", "seed", "passcode", "jwt", "session", "cookie", "webhook", "signature", "aws_access_key", "hmac", "salt", "refresh", "otp", "pin", "secret_key", "secret_access_key", "login", "password", "passwd", "secret", "token",
)
HEADS = ("ghp_", "gho_", "sk_live_", "pk_live_", "sk-", "xoxb-", "xoxp-", "glpat-", "npm_", "eyJ", "SG.", "AIza", "hf_", "dop_v1_", "shpat_", "AGE-SECRET-KEY-")
OTHERS = ("id", "version", "build", "see", "file", "page", "isbn", "order", "sku", "ref", "item", "model", "serial", "ticket", "room", "flight", "image", "photo", "section", "commit", "uuid", "path", "part", "date", "phone", "no", "the", "of")
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _LETTERS + _LETTERS.upper() + _DIGITS


def _drawn(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))


def cues(words: Words) -> np.ndarray:
    """The numbers of the tokens that are one of CUES in either case."""
    own = Words(*utf8(pa.array(CUES, pa.string())), SEPARATORS)
    known, size = np.sort(own.hashes()), words.end - words.start
    some = np.flatnonzero((size >= 2) & (size <= max(map(len, CUES))))
    h = words.only(some).hashes(lower=True)
    return some[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]


def after_cue(words: Words) -> np.ndarray:
    """Which tokens come, AFTER at most, after a cue and an assignment sign, with no quote, line end or final dot since."""
    n, raw = len(words.start), words.raw
    after = np.append(words.start[1:], len(raw))
    here = cues(words)
    here = here[_counts(ASSIGNS[raw], words.end[here], after[here]) > 0]
    last = np.full(n + 1, -1)
    last[here + 1] = here
    last = np.maximum.accumulate(last)[:n]
    closed = (_counts(QUOTES[raw] | NEWLINES[raw], words.end, after) > 0) | (raw[words.end - 1] == 46)
    total = np.concatenate([[0], np.cumsum(closed)])
    i, text = np.arange(n), words.text_of()
    # the cue's own quote opens what follows
    return (last >= 0) & (i - last <= AFTER) & (text[last] == text) & (total[i] == total[np.minimum(last + 1, n)])


def _phrase(rng: np.random.Generator, own: list[str], least: int, most: int) -> list[str]:
    """Words drawn from own, or made up."""
    return [str(own[int(rng.integers(0, len(own)))]) if own and rng.random() < 0.8 else _drawn(rng, _LETTERS, int(rng.integers(3, 9))) for _ in range(int(rng.integers(least, most)))]


def planted_secret(rng: np.random.Generator, own: list[str]) -> tuple[str, list[str], str]:
    """What stands before a made-up secret, its parts, and what stands between them: a key of several lines, a phrase of several words (mostly of own), or one token."""
    kind = int(rng.integers(0, 8))
    between = str(rng.choice([" = ", "=", ": ", ":", " ", ' = "', '="', ": '", " => "]))
    if kind == 5:
        return "BEGIN PRIVATE KEY\n", [_drawn(rng, _MIXED + "+/", 64) for _ in range(int(rng.integers(2, 5)))], "\n"
    if kind > 5:
        cue = str(rng.choice(["passphrase", "recovery phrase", "seed phrase", "mnemonic", "password", "backup phrase", "wallet seed"]))
        return cue + str(rng.choice([": ", " = ", ' = "', ": '", "="])), _phrase(rng, own, 3, 13), str(rng.choice([" ", " ", ", "]))
    alphabet = (_MIXED, _MIXED + "+/", _LETTERS + _DIGITS, _MIXED + "_-", _LETTERS.upper() + _DIGITS)[int(rng.integers(0, 5))]
    head = str(rng.choice(HEADS)) if kind < 2 else ""
    body = _drawn(rng, alphabet, int(rng.integers(16, 64)))
    cue = str(rng.choice(CUES)) if kind > 0 or not head else str(rng.choice(OTHERS))
    if rng.random() < 0.3:
        cue = cue.upper()
    if rng.random() < 0.1:
        cue, between = f"{rng.choice(CUES)}: {rng.choice(['Bearer', 'Basic', 'Token', 'Key'])}", " "
    return cue + between, [head + body], ""


def planted_other(rng: np.random.Generator, own: list[str]) -> str:
    """What looks like a secret and is none: a made-up token after a word that is no cue, a cue in running text, or words after a sign."""
    d, h = (lambda n: _drawn(rng, _DIGITS, n)), (lambda n: _drawn(rng, "0123456789abcdef", n))
    made = (
        lambda: f"{h(8)}-{h(4)}-4{h(3)}-a{h(3)}-{h(12)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}:3{d(1)}:2{d(1)}", lambda: f"IMG_{d(8)}_{d(6)}.jpg", lambda: f"{_drawn(rng, _LETTERS.upper(), 2)}-{d(4)}-{_drawn(rng, _LETTERS.upper(), 3)}",
        lambda: f"{_drawn(rng, _LETTERS, 6)}{d(2)}@{_drawn(rng, _LETTERS, 7)}.com", lambda: f"www.{_drawn(rng, _LETTERS, 9)}.org/{_drawn(rng, _LETTERS, 5)}/{d(4)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}-beta{d(1)}", lambda: f"get{_drawn(rng, _LETTERS, 5).title()}By{_drawn(rng, _LETTERS, 6).title()}{d(1)}",
        lambda: f"{_drawn(rng, _LETTERS, 5)}_{_drawn(rng, _LETTERS, 7)}_{d(3)}.tar.gz", lambda: f"+{d(2)}-{d(3)}-{d(7)}x{d(2)}", lambda: f"{d(1)}.{d(4)}e-{d(2)}", lambda: f"{_drawn(rng, _LETTERS, 8).title()}{_drawn(rng, _LETTERS, 9).title()}{_drawn(rng, _LETTERS, 7).title()}",
    )[int(rng.integers(0, 12))]()
    kind = rng.random()
    if kind < 0.25:
        return str(rng.choice(CUES))
    if kind < 0.4:
        return str(rng.choice(OTHERS)) + str(rng.choice([": ", " = ", "="])) + " ".join(_phrase(rng, own, 3, 9)) + "."
    return str(rng.choice(OTHERS)) + str(rng.choice([" ", ": ", "=", ' "', " ("])) + made


def with_planted(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """text with a made-up secret and a look-alike put between its words, and the secret's places."""
    parts = text.split(" ")
    cut = sorted(int(i) for i in rng.integers(0, len(parts) + 1, 2))
    own = [p for p in parts if p.isalpha() and p.islower() and 2 < len(p) < 12]
    other, (cue, secret, joint) = planted_other(rng, own), planted_secret(rng, own)
    pieces = [" ".join(parts[: cut[0]]), other, " ".join(parts[cut[0] : cut[1]])]
    before = " ".join(p for p in pieces if p) + " " + cue
    spans, whole = [], before
    for i, part in enumerate(secret):
        whole += joint * (i > 0)
        spans.append((len(whole), len(whole) + len(part), i))
        whole += part
    quote = next((q for q in "\"'" if cue.endswith(q)), "")
    return whole + (quote or "." * (joint in (" ", ", "))) + " " + " ".join(parts[cut[1] :]), spans


def _labels(words: Words, at: np.ndarray, spans: list[list[Span]], texts: list[str]) -> np.ndarray:
    """States of the tokens numbered at: begin or inside for those in a text's spans (start, end, number inside the secret)."""
    y = np.zeros(len(words.start), dtype=np.int64)
    for i, (text, found) in enumerate(zip(texts, spans, strict=True)):
        for a, b, part in found:
            a, b = words.at[i] + len(text[:a].encode()), words.at[i] + len(text[:b].encode())
            inside = np.arange(words.first[i], words.first[i + 1])
            inside = inside[(words.start[inside] < b) & (words.end[inside] > a)]
            y[inside] = 2
            if len(inside) and not part:
                y[inside[0]] = 1
    return y[at]


def base_secrets(text: str) -> list[Span]:
    """The secret parts of the base patterns' matches."""
    found = []
    for a, b, kind in base_spans(text):
        m = ASSIGN.match(text, a) if kind == 0 else None
        found.append((m.start(2), m.end(2), 0) if m else (a, b, 0))
    return found


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, most_chains: int = 12_000, longest: int = 64) -> Field:
    """Fits the field on at most train_rows documents, those with the least hashed ids, and most_chains chains of at most longest tokens (what is longer is cut off): bounds of the training rows only.

    Chains are those of windows() and, an eighth as many at most, stretches of plain text. A document's text is taken as it is, labelled by the base patterns, and once more with a made-up secret and a look-alike planted in it, so that words before, shapes and
    places are learnt that the base patterns don't know. Chains without a secret are as many as the others at least. Without documents the field finds nothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("text"))
    # at most train_rows ids, chosen without their texts and small enough to be broadcast
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(train_rows)
    picked = rows.join(F.broadcast(ids), "i", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            planted = [with_planted(t, np.random.default_rng(zlib.crc32(t.encode()))) for t in own]
            texts = own + [t for t, _ in planted]
            words = Words(*utf8(pa.array(texts, pa.string())), SEPARATORS)
            found = [base_secrets(t) for t in own] + [s + base_secrets(t) for t, s in planted]
            out = []
            for at, kind in ((windows(words), 0), (plain(words), 2)):
                if not len(at):
                    continue
                x, buckets = features(words, at)
                y = _labels(words, at, found, texts)
                begins = chains(words, at)
                ends = np.minimum(np.append(begins[1:], len(at)), begins + longest)
                out += [(np.packbits(x[a:b], axis=None).tobytes(), buckets[a:b].astype("<i2").tobytes(), y[a:b].astype(np.int8).tobytes(), 1 if (y[a:b] > 0).any() else kind) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int32()))], names=["x", "b", "y", "kind"])

    made = picked.select("text").mapInArrow(cut, "x binary, b binary, y binary, kind int")
    # half of the chains of windows at least have no secret
    order = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("x", "b", "y"), "x", "b", "y"))
    made = made.withColumn("place", order).where(F.col("place") <= F.when(F.col("kind") == 2, most_chains // 8).otherwise(most_chains // 2)).toArrow()
    width = len(FEATURES)
    if not len(made):
        return Field(np.eye(STATES, width) * 9.0, np.zeros((len(HASHED), BUCKETS, STATES)), np.zeros((STATES, STATES)))
    ys = [np.frombuffer(b, dtype=np.int8) for b in made.column("y").to_pylist()]
    size = np.array([len(y) for y in ys])
    x = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n * width).reshape(n, width) for b, n in zip(made.column("x").to_pylist(), size.tolist(), strict=True)])
    buckets = np.concatenate([np.frombuffer(b, dtype="<i2").reshape(-1, len(HASHED)) for b in made.column("b").to_pylist()]).astype(np.int64)
    return train_field(x, buckets, np.concatenate(ys).astype(np.int64), np.cumsum(size) - size)


def _crf_spans(field: Field, words: Words) -> list[tuple[int, int, int]]:
    """(text's number, start, end in bytes) of each begin and the insides after it, of the best paths through all tokens of each text.

    Tokens that are surely outside part a path exactly, since a chain begins and ends outside; only the runs between them are decoded.
    """
    every = np.arange(len(words.start))
    if not len(every):
        return []
    score = field.emissions(*features(words, every))
    at = np.flatnonzero(field.unsure(score))
    if not len(at):
        return []
    begins = chains(words, at)
    state = field.decode(score[at], begins)
    fresh = np.zeros(len(at), dtype=bool)
    fresh[begins] = True
    begin = (state == 1) | ((state == 2) & (fresh | (np.concatenate([[0], state[:-1]]) == 0)))
    text = words.text_of()[at]
    out = []
    for i in np.flatnonzero(begin).tolist():
        j = i
        while j + 1 < len(state) and state[j + 1] == 2 and not fresh[j + 1] and not begin[j + 1]:
            j += 1
        out.append((int(text[i]), int(words.start[at[i]]), int(words.end[at[j]])))
    return out


def scan(docs: DataFrame, field: Field, mark: str | None = None) -> DataFrame:
    """docs with each row's spans (array of kind, start, end in code points, by start, then kind as listed); an input column of
    this name is replaced. With a mark, each stretch that spans cover is replaced by it in text.

    Base spans stay; the field adds (kind crf) those of its spans that overlap none of them. Null text: no spans, and
    null stays. Repeated rows are scanned alike. Empty input: no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    docs = docs.drop("spans").withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    schema = docs.withColumn("spans", F.expr("cast(null AS array<struct<kind: string, start: bigint, end: bigint>>)")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(at).to_pylist()
            texts = [t or "" for t in whole]
            words = Words(*utf8(batch.column(at)), SEPARATORS)
            added: dict[int, list[tuple[int, int]]] = {}
            for i, a, b in _crf_spans(shared.value, words):
                data = words.raw[words.at[i] : words.at[i + 1]].tobytes()
                a, b = a - int(words.at[i]), b - int(words.at[i])
                start = len(data[:a].decode())
                added.setdefault(i, []).append((start, start + len(data[a:b].decode())))
            rows = []
            for i, text in enumerate(texts):
                spans = base_spans(text)
                spans += [(a, b, 3) for a, b in added.get(i, ()) if all(b <= s or e <= a for s, e, _ in spans)]
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in sorted(spans, key=lambda x: (x[0], x[2]))])
            columns = batch.columns
            if mark is not None:
                columns[at] = pa.array([t and redact(t, [(s["start"], s["end"]) for s in found], mark) for t, found in zip(whole, rows, strict=True)], pa.string())
            spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, type=spans_type)], names=schema.names)

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
