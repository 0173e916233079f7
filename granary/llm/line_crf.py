"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or boilerplate.

Viterbi decoding finds the best marking; the share of word characters on content lines decides
whether a document stays. Beside it stand the counts of the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.linear import fit_logistic

WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
SYMBOLS = "#*$%&|<>"
#: Phrases of notices and navigation.
NOTICE = re.compile(
    r"all rights reserved|copyright|\(c\) |©|licen[sc]e|terms of (?:use|service)|privacy policy|cookie|"
    r"subscribe|sign up|log ?in|click here|read more|share this|follow us|contact us|home \||next page|https?://|www\.",
    re.IGNORECASE,
)
FEATURES = (
    "always", "blank", "one_word", "few_words", "many_words", "symbols", "marked_words", "bars", "shouting",
    "exclaiming", "repeats_words", "digits", "notice", "seen_before", "sentence_end", "long_words",
)
#: Weights that the fit shrinks to, so that few labels already give a usable marking (content is positive).
PRIOR = (1.5, -1.0, -0.5, 0.0, 1.0, -3.0, -3.0, -3.0, -3.0, -3.0, -4.0, -1.0, -3.0, -1.0, 1.0, -1.0)
PRIOR_LINK = 0.5
MOST_LINK = 1.5
LABELLED_ROWS = 5_000
#: Bound of the fit: the most frequent kinds of (line, neighbours, mark) that the labelled documents hold.
LABELLED_LINES = 200_000
CONTENT_SHARE = 0.5
MIN_WORDS = 50


#: Each match of ``NOTICE`` holds one of these when lower-cased, unless it is written with one of ``ODD_LETTERS``.
NOTICE_PARTS = (
    "all rights", "copyright", "(c) ", "©", "licen", "terms of", "privacy", "cookie", "subscribe", "sign up", "login", "log in",
    "click here", "read more", "share this", "follow us", "contact us", "home |", "next page", "http", "www.",
)
ODD_LETTERS = re.compile("[\u017f\u0130\u0131\u212a]")
#: White space to ``str.split`` that ``WORDS`` does not take for such.
SEPARATORS = re.compile("[\x1c-\x1f]")
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
LETTERS, SIGNS = CAPITALS + CAPITALS.lower(), SYMBOLS.encode()


def line_table(text: str) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """Per line the 0/1 ``FEATURES`` and the characters in words; the words and the number of ``SYMBOLS`` of the text."""
    lines, low = text.split("\n"), text.lower()
    odd = not text.isascii() and ODD_LETTERS.search(text) is not None
    parts = [p for p in NOTICE_PARTS if p in low]
    lows = low.split("\n") if parts else lines
    plain = SEPARATORS.search(text) is None
    x, sizes, every, all_symbols = [], [], [], 0
    seen: set[str] = set()
    for line, small in zip(lines, lows, strict=True):
        if line.isascii():
            words = line.split() if plain else WORDS.findall(line)
            raw = line.encode()
            count = lambda signs, raw=raw: len(raw) - len(raw.translate(None, signs))
            symbols, letters, capitals, digits = count(SIGNS), count(LETTERS), count(CAPITALS), count(DIGITS)
        else:
            words = WORDS.findall(line)
            symbols, letters = sum(map(line.count, SYMBOLS)), sum(map(str.isalpha, line))
            capitals, digits = sum(map(str.isupper, line)), sum(map(str.isdigit, line))
        n = len(words)
        if not n:
            x.append((1, 1, *[0] * (len(FEATURES) - 2)))
            sizes.append(0)
            continue
        every += words
        lengths = [*map(len, words)]
        chars = sum(lengths)
        sizes.append(chars)
        all_symbols += symbols
        marked = sum(w[-1] in SYMBOLS for w in words) if symbols else 0
        notice = (odd or any(p in small for p in parts)) and NOTICE.search(line) is not None
        x.append((
            1, 0, n == 1, n < 5, n >= 12, symbols * 10 > chars, marked * 4 > n, line.count("|") * 4 > n,
            capitals * 2 > letters > 3, line.count("!") * 4 > n, n >= 6 and len(set(words)) * 5 < n * 2,
            digits * 4 > chars, notice, line in seen, (line.rstrip() or " ")[-1] in ".!?:;\"'", max(lengths) > 40,
        ))
        seen.add(line)
    return np.array(x, dtype=np.float64), np.array(sizes, dtype=np.float64), every, all_symbols


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Per line: the 0/1 ``FEATURES``, and the characters in words."""
    return line_table(text)[:2]


@dataclass(frozen=True)
class LineCrf:
    weights: np.ndarray
    link: float  # score of two neighbours of one kind; its negative for two of different kinds

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best marking of the lines, 1 for content; ties go to content."""
        unary = (x @ self.weights / 2).tolist()
        back: list[tuple[bool, bool]] = [(False, False)]
        boilerplate, content = -unary[0], unary[0]
        link = self.link
        for u in unary[1:]:
            stay, come = boilerplate + link, content - link
            low = max(stay, come) - u
            stays, comes = content + link, boilerplate - link
            back.append((come > stay, stays >= comes))
            content = max(stays, comes) + u
            boilerplate = low
        out = np.zeros(len(x), dtype=np.int8)
        now = out[-1] = content >= boilerplate
        for t in range(len(x) - 1, 0, -1):
            now = out[t - 1] = back[t][now]
        return out


def fit_line_crf(docs: DataFrame, labels: DataFrame) -> LineCrf:
    """Fits by pseudo-likelihood on at most ``LABELLED_ROWS`` labelled documents, by a hash of the id, and of their
    lines on at most ``LABELLED_LINES`` distinct kinds, the most frequent ones.

    A line of a good document counts as content unless it looks like a notice or repeats an earlier
    line, a line of another document as boilerplate. Null ids and labels are left out; an id with several labels
    has the smallest. Without labels the prior weights stay.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED_ROWS)
    )
    notice, again = FEATURES.index("notice"), FEATURES.index("seen_before")
    n = len(FEATURES)

    def observe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for text, quality in zip(frame["text"], frame["quality"], strict=True):
                x = line_features(text or "")[0]
                y = (quality == 1) & (x[:, notice] == 0) & (x[:, again] == 0)
                sign = np.where(y, 1, -1)
                near = np.concatenate([[0], sign[:-1]]) + np.concatenate([sign[1:], [0]])
                parts.append(np.column_stack([x, near, y]).astype(np.int8))
            # Equal rows are summed up: there are few kinds of lines.
            kinds, rows = np.unique(np.vstack(parts), axis=0, return_counts=True) if parts else (np.zeros((0, n + 2)), [])
            yield pd.DataFrame({"kind": [bytes(k.tobytes()) for k in kinds], "rows": rows})

    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "quality")
    kinds = texts.mapInPandas(observe, "kind binary, rows long").groupBy("kind").agg(F.sum("rows").alias("rows"))
    found = kinds.orderBy(F.desc("rows"), "kind").limit(LABELLED_LINES).toPandas()
    table = np.array([np.frombuffer(k, np.int8) for k in found["kind"]]).reshape(-1, n + 2).astype(np.float64)
    rows = found["rows"].to_numpy(np.float64)
    # The link counts twice in the log odds of a line given its neighbours.
    x = np.column_stack([table[:, :n], 2 * table[:, n]])
    ridge = np.append(np.full(n, 5.0), 50.0)
    w = fit_logistic(x, table[:, n + 1], rows, ridge, np.append(PRIOR, PRIOR_LINK))
    return LineCrf(w[:n], float(np.clip(w[n], 0, MOST_LINK)))


def repeated_windows(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text holds twice or more, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = codes[:n]
    for k in range(1, width):
        windows = windows * len(ids) + codes[k : k + n]
        if k + 1 < width and len(ids) > 1 << 20:
            windows = np.unique(windows, return_inverse=True)[1]
    inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)[1:]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def judged(text: str | None, model: LineCrf) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share of one text."""
    x, sizes, words, symbols = line_table(text or "")
    total = sizes.sum()
    share = float((sizes * model.decode(x)).sum() / total) if total else 0.0
    again = int(x[:, FEATURES.index("seen_before")].sum())
    return len(words), int(total), symbols, again, repeated_windows(words), share


def apply_rules(docs: DataFrame, model: LineCrf, content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the counts, ``content_share``, ``base_failed`` and ``kept`` per row of ``docs``.

    Null and empty texts have no words and fail; a text of any length is judged whole; repeated rows are judged
    each, a null id stays null. Other columns are not read; a table without rows gives none.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"]
        kinds = [pa.int64()] * 5 + [pa.float64()]
        for batch in batches:
            rows = [judged(t, model) for t in batch.column(1).to_pylist()]
            counts = zip(*rows, strict=True) if rows else [()] * len(names)
            columns = [pa.array(c, kind) for c, kind in zip(counts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    shape = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judge, shape + ", content_share double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("content_share") >= content_share)
    )
