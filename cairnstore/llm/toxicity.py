"""Toxicity with noisy-channel deobfuscation.

1. A character language model (trigrams over a-z, a word edge and one class for any other letter) is counted over
   every whole document; the counts are at most 28 cubed rows, whatever the corpus's size.
2. A token that looks disguised (digits or symbols beside letters, a letter tripled, letters of other scripts among
   a-z, letters spaced out) becomes a lattice: each written character, or group of them, offers its letter readings,
   nothing if it separates or repeats, or a word's end if it separates. A Viterbi search over its full length finds
   the reading that is likeliest under channel and language model. Readings of short tokens are kept in a bounded
   table, so a token is mostly decoded once a task; that changes no reading.
3. Words of the restored text, and their prefixes, are weighed by the lower confidence bound of their log odds of
   label 1 in the training rows (documents counted, not occurrences); a logistic layer over a document's heaviest
   words gives its score.

Labels are learned from a bounded sample (`TRAINING_ROWS`) outside the held-out third.

Defined results: a null or empty text scores as one without heavy words; without training rows of both labels
every score is 0; null labels are not learned from; rows of one doc_id are scored one by one, an id labelled twice
counts with its larger label; other columns do not matter. A token of any length is decoded whole, in time and memory
in proportion to it; of two words of equal weight it does not matter which comes first.
"""

from __future__ import annotations

import re
from functools import cache
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import checkpointed, held_out, map_columns, training_rows

#: Labelled documents that weights and the logistic layer are fitted on, at most.
TRAINING_ROWS = 20_000
#: Predicted toxic from this score on.
THRESHOLD = 0.7
#: Documents of label 1 that a feature must stand in.
SUPPORT = 4
#: Features that the driver collects, at most: the heaviest.
FEATURES = 500_000
#: Tokens that a task remembers, and the longest of them; longer ones are decoded each time.
TABLE_ROWS = 200_000
LONGEST_REMEMBERED = 40

# Letters that digits and symbols commonly stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "×": "x",
}
# Groups of characters that stand for a letter.
GROUPS = {"|-|": "h", "\\/\\/": "w", "\\/": "v", "/\\": "a", "()": "o", "|)": "d", "|<": "k", "|_|": "u", "vv": "w", "ph": "f"}
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "к": "k", "м": "m",
    "т": "t", "п": "n", "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "η": "n", "ε": "e",
}
SEPARATORS = frozenset(".-_*~'`^,:;/\\ ")
EDGE, OTHER = 0, 27
_LETTERS = {chr(97 + i): i + 1 for i in range(26)}
_TRIM = ".,;:?%&#\"'`)]}>»”’[{<«“‘…*-_~/\\=^"
_TAIL = re.compile(r"([^\w])\1+$|[!$+|(@]+$")
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*]{1,2}[^\s.\-_*](?=[ .\-_*]|$|\n)){2,}")
# What any run of three spaced letters ends in; faster to look for.
_SPACED_HINT = re.compile(r"[ .\-_*][^\s.\-_*][ .\-_*]{1,2}[^\s.\-_*](?=[ .\-_*\n]|\Z)")
_REPEAT = re.compile(r"(.)\1+")
_RUN = re.compile(r"(.)\1\1")
_DISGUISED = re.compile(r"[^\W\d_].*[\W\d_]|[\W\d_].*[^\W\d_]|(.)\1\1", re.S)
_LATIN, _ALIKE = re.compile("[a-z]"), re.compile(f"[{''.join(LOOKALIKES)}]")


def code_of(c: str) -> int:
    return EDGE if c == " " else _LETTERS.get(c, OTHER)


# ---- the language model


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over every whole document."""

    def make():
        import numpy as np

        codes = np.full(0x110000, OTHER, dtype=np.int32)
        codes[97:123] = np.arange(1, 27)
        codes[65:91] = np.arange(1, 27)
        codes[[32, 9, 10, 11, 12, 13]] = EDGE
        total = np.zeros(28**3, dtype=np.int64)

        def work(texts):
            nonlocal total
            for t in texts:
                if t:
                    c = codes[np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
                    total += np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)

        def end():
            at = np.flatnonzero(total)
            return at.tolist(), total[at].tolist()

        work.end = end
        return work

    return map_columns(docs, ["text"], make, "trigram int, n bigint").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> list[float]:
    """log P(c | a, b) at (a * 28 + b) * 28 + c, smoothed by adding one."""
    counts = [1] * 28**3
    for r in trigram_counts(docs).collect():  # at most 28**3 rows
        counts[r.trigram] += r.n
    out = []
    for ab in range(28 * 28):
        own = counts[ab * 28 : ab * 28 + 28]
        whole = log(sum(own))
        out += [log(n) - whole for n in own]
    return out


# ---- the channel


@cache
def ways_of(c: str, again: bool) -> tuple[tuple[str, int, float], ...]:
    """(reading, its code, log channel probability) of a character; ``again`` if it repeats the one before.

    An empty reading drops a character, a space ends a word.
    """
    if c in _LETTERS:
        ways = [(c, -0.05)]
    elif c in LOOKALIKES:
        ways = [(LOOKALIKES[c], -0.3), (c, -2.0)]
    elif c.isalpha():
        ways = [(c, -0.05)]
    elif c in SEPARATORS:
        ways, again = [("", -0.1), (" ", -0.7)], False
    else:
        ways = [(r, -0.7) for r in READINGS.get(c, "")] + [(c, -3.0), ("", -4.0)]
    if again:
        ways.append(("", -0.7))
    return tuple((r, code_of(r), cost if r else cost + DROPPED) for r, cost in ways)


_GROUPS_AT = {c: [g for g in GROUPS if g[0] == c] for c in {g[0] for g in GROUPS}}
#: What a dropped character costs: about as much as a letter under the language model.
DROPPED = -1.5


def _extend(step: dict, best: dict, reading: str, c: int, cost: float, model: list[float]) -> None:
    """Put the states of ``best`` with one more reading into ``step`` where they are likelier."""
    if not reading:
        for state, (score, chain) in best.items():
            known = step.get(state)
            if known is None or score + cost > known[0]:
                step[state] = (score + cost, chain)
        return
    for (a, b), (score, chain) in best.items():
        value, state = score + cost + model[(a * 28 + b) * 28 + c], (b, c)
        known = step.get(state)
        if known is None or value > known[0]:
            step[state] = (value, (reading, chain))


def restore(token: str, model: list[float]) -> str:
    """The likeliest reading of a token, by Viterbi search over states of the last two letters; it may have spaces.

    A state holds its reading as a chain of letters that it shares with other states, so what no state leads to any
    more is given up and memory grows with the token only.
    """
    best: dict = {(EDGE, EDGE): (0.0, None)}
    ahead: dict[int, dict] = {}  # states that groups lead to, by the place where they end
    before = ""
    for k, c in enumerate(token):
        step = ahead.pop(k + 1, None) or {}
        for reading, code, cost in ways_of(c, c == before):
            _extend(step, best, reading, code, cost, model)
        for group in _GROUPS_AT.get(c, ()):
            if token.startswith(group, k):
                reading = GROUPS[group]
                cost = -0.7 + DROPPED * (len(group) - 1)
                _extend(ahead.setdefault(k + len(group), {}), best, reading, code_of(reading), cost, model)
        best, before = step, c
    score, chain = max(
        ((score + model[(a * 28 + b) * 28 + EDGE], chain) for (a, b), (score, chain) in best.items()), key=lambda x: x[0]
    )
    out = []
    while chain is not None:
        reading, chain = chain
        out.append(reading)
    return "".join(reversed(out))


def restorer(model: list[float]):
    """A function from a lower-cased token to the words that are scored: as written, and restored."""
    table: dict[str, tuple[str, ...]] = {}

    def decoded(token: str) -> tuple[str, ...]:
        plain = token.strip(_TRIM)
        if plain.isalpha():
            mixed = not plain.isascii() and _ALIKE.search(plain) and _LATIN.search(plain)
            if not mixed and not _REPEAT.search(plain):
                return (plain,)
            out, disguised = [plain], [plain] if mixed or _RUN.search(plain) else []
        else:
            bare = _TAIL.sub("", plain).strip(_TRIM) or plain
            out = [] if " " in bare else [bare]
            disguised = [x for x in dict.fromkeys((bare, plain)) if _DISGUISED.search(x)]
        for x in disguised:
            out += restore(x, model).split()
        out += [_REPEAT.sub(r"\1", x) for x in out[1:] or out if _REPEAT.search(x)]
        return tuple(dict.fromkeys(x for x in out if x))

    def readings(token: str) -> tuple[str, ...]:
        known = table.get(token)
        if known is None:
            known = decoded(token)
            if len(token) <= LONGEST_REMEMBERED:
                if len(table) >= TABLE_ROWS:
                    table.clear()
                table[token] = known
        return known

    return readings


def tokens_of(text: str | None) -> set[str]:
    """The distinct tokens of a whole text, and the runs of letters that are spaced out."""
    text = (text or "").lower()
    out = set(text.split())
    if _SPACED_HINT.search(text):
        out.update(m[0] for m in _SPACED.finditer(text) if len(set(m[0]) - SEPARATORS) > 2)
    return out


def words_of(text: str | None, readings) -> set[str]:
    """The distinct restored words of a whole text."""
    out: set[str] = set()
    for token in tokens_of(text):
        out.update(readings(token))
    return out


def features_of(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in (3, 4, 5, 6) if len(word) > n)]


# ---- weights and score


def _weights(sample: DataFrame, model: list[float]) -> dict[str, float]:
    """Lower confidence bounds of the features' log odds, where positive."""

    def make():
        readings = restorer(model)
        counts: dict[str, list[int]] = {}

        def flush():
            out = [list(x) for x in zip(*((k, v[0], v[1]) for k, v in counts.items()), strict=True)] if counts else None
            counts.clear()
            return out

        def work(texts, labels):
            for t, y in zip(texts, labels, strict=True):
                found: set[str] = set()
                for w in words_of(t, readings):
                    found.update(features_of(w))
                for f in found:
                    counts.setdefault(f, [0, 0])[int(y > 0)] += 1
            return flush() if len(counts) > 500_000 else None

        work.end = flush
        return work

    table = map_columns(sample, ["text", "label"], make, "feature string, n0 bigint, n1 bigint")
    n = {bool(r.y): r.n for r in sample.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    odds = F.log((F.col("n1") + 0.5) / n[True]) - F.log((F.col("n0") + 0.5) / n[False])
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    kept = (
        table.groupBy("feature")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n1") >= SUPPORT)
        .select("feature", (odds - 2 * error).alias("w"))
        .where(F.col("w") > 0)
        .orderBy(F.desc("w"), "feature")
        .limit(FEATURES)
    )
    return {r.feature: r.w for r in kept.collect()}


def weigher(model: list[float], weights: dict[str, float]):
    """A function from a text to the weights of its two heaviest restored words.

    What it remembers of a token are its words that weigh anything, which for most tokens are none.
    """
    readings, table, get = restorer(model), {}, weights.get
    # Every feature of a word starts like the word.
    starts = {f.removeprefix("=")[:3] for f in weights}

    def heavy(token: str) -> tuple[tuple[str, float], ...]:
        found = [(word, max([get(f, 0.0) for f in features_of(word)])) for word in readings(token) if word[:3] in starts]
        found = tuple((word, w) for word, w in found if w > 0)
        if len(token) <= LONGEST_REMEMBERED:
            if len(table) >= TABLE_ROWS:
                table.clear()
            table[token] = found
        return found

    def look(text: str | None) -> tuple[float, float]:
        words: dict[str, float] = {}
        known = table.get
        for token in tokens_of(text):
            found = known(token)
            if found is None:
                found = heavy(token)
            if found:
                words.update(found)
        top = sorted(words.values(), reverse=True)[:2]
        return (*top, 0.0, 0.0)[:2]

    return look


def _layer(rows: list[tuple[float, float, int]]) -> list[float]:
    """Logistic regression on (first, second, 1) by Newton's method with a small ridge."""
    import numpy as np

    x = np.array([[a, b, 1.0] for a, b, _ in rows])
    y = np.array([float(c > 0) for _, _, c in rows])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0, 0.01])
        step = np.linalg.solve(h, x.T @ (y - p) - np.array([1.0, 1.0, 0.01]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row."""
    model = language_model(docs)
    context = docs.sparkSession.sparkContext
    sample = checkpointed(training_rows(docs, labels, label, bound))
    shared = context.broadcast((model, _weights(sample, model)))

    def fit():
        look = weigher(*shared.value)

        def work(texts, ys):
            found = [look(t) for t in texts]
            return [f[0] for f in found], [f[1] for f in found], ys

        return work

    rows = map_columns(sample, ["text", "label"], fit, "a double, b double, y int")
    seen = [(r.a, r.b, r.y) for r in rows.orderBy("a", "b", "y").collect()] if shared.value[1] else []
    layer = _layer(seen) if seen else None

    def make():
        look = weigher(*shared.value)

        def work(ids, texts, out):
            scores = []
            for t in texts:
                if layer is None:
                    scores.append(0.0)
                else:
                    a, b = look(t)
                    scores.append(1 / (1 + exp(-min(max(layer[0] * a + layer[1] * b + layer[2], -500), 500))))
            return ids, out, scores, [int(s >= THRESHOLD) for s in scores]

        return work

    return map_columns(
        docs.select("doc_id", "text", held_out().alias("held_out")),
        ["doc_id", "text", "held_out"],
        make,
        "doc_id bigint, held_out boolean, score double, predicted int",
    )
