"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters are fixed lexicons, fixed text patterns, and word stems mined from labelled rows. Each fires
or not on a text. The label model (two classes, estimated by expectation maximization, known labels
held) gives every voter's firing rate per class, its accuracy, and the correlations of the voters
within the classes; a voter's evidence is divided by how much of it other voters repeat. The
classifier sees single words and stems, so it can weigh members of one lexicon apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fold_of
from granary.session import written

#: General abuse in four languages, one voter per line.
LEXICONS = {
    "intellect": "idiot moron imbecile stupid dumb dumbass fool cretin dimwit halfwit brainless ignorant simpleton",
    "worth": "worthless pathetic loser useless failure nobody hopeless miserable pitiful coward weakling",
    "disgust": "disgusting trash garbage scum filth filthy vermin vile vomit rotten maggot parasite pig rat",
    "mockery": "clown joke freak weirdo creep laughingstock ugly fatso crybaby buffoon",
    "profanity": "fuck fucking fucker shit shitty bitch bastard asshole bullshit crap damn dick piss",
    "hostility": "hate despise kill die murder destroy hang exterminate",
    "german": "idiot dummkopf trottel arschloch scheisse scheiße abschaum versager dreck drecksau hurensohn wichser blöd dumm",
    "french": "idiot imbécile crétin connard connasse merde ordure salaud salope débile abruti minable raté putain",
    "spanish": "idiota imbécil estúpido estúpida basura mierda cabrón pendejo gilipollas escoria inútil asqueroso puta",
}
#: Characters that stand in for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
TOKEN = re.compile(r"\w+")
MASKED = re.compile(r"\b\w+[@$!*01345]+\w*")
GRAWLIX = re.compile(r"[@#$%&*]{3}")
PATTERNS = ("insult_run", "dense_insults", "masked_insult", "grawlix", "shouting", "exclaiming")

STEM_LENGTHS = (3, 4, 5, 6)
#: Bounds of what is learnt: labelled rows read, features kept, stems that vote.
LABELLED_ROWS, MAX_CANDIDATES, MAX_FEATURES, MAX_STEMS = 20_000, 2_000, 300, 40
#: Share of the documents labelled clean that a rejection may cost.
CLEAN_LOST = 0.005
MIN_SUPPORT, MIN_PRECISION, MIN_CONTEXTS = 5, 0.8, 5
EM_ROUNDS, FOLDS, PRIOR_ROWS, NEWTON_ROUNDS = 10, 5, 100, 30


@dataclass(frozen=True)
class Features:
    """Words (exact) and stems (``word*``), looked up by their first three characters."""

    names: tuple[str, ...]
    voters: tuple[int, ...]  # of each feature, -1: none
    n_voters: int

    def families(self) -> dict[str, list[tuple[str, bool, int]]]:
        out: dict[str, list[tuple[str, bool, int]]] = {}
        for i, name in enumerate(self.names):
            stem = name.endswith("*")
            word = name.removesuffix("*")
            out.setdefault(word[:3], []).append((word, stem, i))
        return out


@dataclass(frozen=True)
class ToxicityModel:
    features: Features
    weights: np.ndarray
    bias: float
    voters: pd.DataFrame  # voter, rate_toxic, rate_clean, accuracy, repeated by others
    correlations: np.ndarray


def found_words(words: set[str], families: dict) -> list[int]:
    out = set()
    for word in words:
        for known, stem, i in families.get(word[:3], ()):
            if word == known or (stem and word.startswith(known)):
                out.add(i)
    return sorted(out)


def found_patterns(text: str, low: str, words: set[str], hits: int, families: dict) -> list[int]:
    """Numbers of the ``PATTERNS`` that the text shows."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    masked = {m.translate(LEET) for m in MASKED.findall(low)} - words
    tests = (
        hits >= 2,
        hits >= 1 and hits * 50 >= len(words),
        bool(masked and found_words(masked, families)),
        GRAWLIX.search(text) is not None,
        upper > 20 and upper > lower,
        text.count("!!") >= 3,
    )
    return [i for i, shown in enumerate(tests) if shown]


def featurize(text: str | None, features: Features, families: dict) -> tuple[list[int], int]:
    """Feature numbers of a text (patterns come after the words) and its votes as bits."""
    text = text or ""
    low = text.lower()
    words = set(TOKEN.findall(low))
    hits = found_words(words, families)
    shown = found_patterns(text, low, words, len(hits), families)
    votes = 0
    for i in hits:
        if features.voters[i] >= 0:
            votes |= 1 << features.voters[i]
    first = features.n_voters - len(PATTERNS)
    for i in shown:
        votes |= 1 << (first + i)
    return hits + [len(features.names) + i for i in shown], votes


def labelled_texts(docs: DataFrame, labels: DataFrame, held_out: int, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents outside the held-out fold, by a hash of the id."""
    known = known_labels(labels, held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def known_labels(labels: DataFrame, held_out: int) -> DataFrame:
    """doc_id, toxic: the largest label where an id has several; null ids and labels are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(fold_of(F.col("doc_id"), FOLDS) != held_out)
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def mined_features(labelled: DataFrame) -> tuple[list[str], set[str]]:
    """Words and stems that labelled toxic texts hold and clean ones do not, strongest first.

    Also the lexicon words that the labels contradict: ``MIN_SUPPORT`` clean texts hold them, and more
    than toxic ones do.

    Strength is the z value of the smoothed log odds over distinct texts; equal ones go by length
    (longer first), then by name. A feature has to follow at least ``MIN_CONTEXTS`` different words:
    the words of a text that was copied with small changes always follow the same ones.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sums = (Counter(), Counter())
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                words = set(TOKEN.findall((text or "").lower()))
                seen = set(words)
                for word in words:
                    seen.update(word[:n] + "*" for n in STEM_LENGTHS if len(word) >= n)
                sums[toxic].update(w for w in seen if len(w) >= 3)
            names = list(sums[0].keys() | sums[1].keys())
            yield pd.DataFrame({"name": names, "clean": [sums[0][w] for w in names], "toxic": [sums[1][w] for w in names]})

    texts = labelled.dropDuplicates(["text"])
    totals = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n_toxic, n_clean = (totals["toxic"] or 0), totals["n"] - (totals["toxic"] or 0)
    counts = texts.mapInPandas(count, "name string, clean long, toxic long").groupBy("name").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = counts.where((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    top = strong.orderBy(F.round(z, 6).desc(), F.length("name").desc(), "name").limit(MAX_CANDIDATES)
    names = [r["name"] for r in top.collect()]
    families = Features(tuple(names), (-1,) * len(names), 0).families()

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: set[tuple[int, str]] = set()
            for text in frame["text"]:
                words = TOKEN.findall((text or "").lower())
                for before, word in zip(["", *words], words, strict=False):
                    if word[:3] in families:
                        found.update((i, before) for i in found_words({word}, families))
            yield pd.DataFrame(list(found), columns=["i", "before"])

    seen = texts.where("toxic = 1").mapInPandas(contexts, "i int, before string").groupBy("i")
    often = {r["i"] for r in seen.agg(F.count_distinct("before").alias("n")).where(F.col("n") >= MIN_CONTEXTS).collect()}
    lexicon = [w for words in LEXICONS.values() for w in words.split()]
    against = counts.where(F.col("name").isin(lexicon) & (F.col("clean") >= MIN_SUPPORT) & (F.col("clean") > F.col("toxic")))
    return [name for i, name in enumerate(names) if i in often], {r["name"] for r in against.collect()}


def one_per_family(mined: list[str], most: int) -> list[str]:
    """The strongest mined features of which none begins another."""
    out: list[str] = []
    for name in mined:
        word = name.removesuffix("*")
        if all(not word.startswith(o) and not o.startswith(word) for o in (x.removesuffix("*") for x in out)):
            out.append(name)
        if len(out) == most:
            break
    return out


def chosen_features(mined: list[str], contradicted: set[str] = frozenset()) -> Features:
    """Lexicon words, and one mined feature per family of words; the strongest of those have a vote of their own.

    Contradicted lexicon words are left out.
    """
    names: dict[str, int] = {}
    for voter, words in enumerate(LEXICONS.values()):
        for word in words.split():
            if word not in contradicted:
                names.setdefault(word, voter)
    # A stem of a lexicon word says nothing that the word does not say more exactly.
    other = [m for m in mined if not any(w.startswith(m.removesuffix("*")) for w in names)]
    mined = one_per_family(other, MAX_FEATURES)
    for k, name in enumerate(mined):
        names[name] = len(LEXICONS) + k if k < MAX_STEMS else -1
    return Features(tuple(names), tuple(names.values()), len(LEXICONS) + min(len(mined), MAX_STEMS) + len(PATTERNS))


def bits(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes.astype(np.int64)[:, None] >> np.arange(n)) & 1).astype(np.float64)


@dataclass(frozen=True)
class LabelModel:
    """Classes, how often each voter fires in them, and how the voters correlate within them.

    Voters that fire together share their evidence by their correlation, and so do those that do not.
    """

    prior: float
    rates: np.ndarray  # [clean or toxic, voter]
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = bits(votes, self.rates.shape[1])
        repeated = np.maximum(self.correlations, 0)
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for who, rates in ((fired, self.rates), (1 - fired, 1 - self.rates)):
            shared = who / np.maximum(who @ repeated, 1)
            logit += shared @ np.log(rates[1] / rates[0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def weighted_sums(patterns: DataFrame, model: LabelModel) -> tuple[np.ndarray, np.ndarray]:
    """Per class, over all documents: their weight, and sums of products of votes.

    Batches are summed where they are; the driver gets at most 2 * voters² numbers.
    """
    n = model.rates.shape[1]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            votes, weight = frame["votes"].to_numpy(), frame["rows"].to_numpy(np.float64)
            label = frame["toxic"].to_numpy(np.float64, na_value=np.nan)
            p = np.where(np.isnan(label), model.posterior(votes), label)
            v = bits(votes, n)
            for c, share in ((0, 1 - p), (1, p)):
                w = share * weight
                products = (v * w[:, None]).T @ v
                i, j = np.nonzero(products)
                yield pd.DataFrame({"c": c, "i": i, "j": j, "x": products[i, j]})
                yield pd.DataFrame({"c": [c], "i": [-1], "j": [-1], "x": [w.sum()]})

    total = patterns.mapInPandas(sums, "c int, i int, j int, x double").groupBy("c", "i", "j").agg(F.sum("x").alias("x"))
    mass, products = np.zeros(2), np.zeros((2, n, n))
    for r in total.collect():
        if r["i"] >= 0:
            products[r["c"], r["i"], r["j"]] = r["x"]
        else:
            mass[r["c"]] = r["x"]
    return mass, products


def fit_label_model(patterns: DataFrame, n: int) -> LabelModel:
    """Label model from (votes, toxic or null, rows) by expectation maximization.

    Known labels are held, and where there are ``PRIOR_ROWS`` of them they give the prior. Rates are
    estimated with independent voters; the correlations, measured under them, enter the posteriors.
    """
    known = patterns.where("toxic is not null").agg(F.sum("rows").alias("n"), F.sum(F.col("rows") * F.col("toxic")).alias("t"))
    labelled = known.first()
    settled = (labelled["n"] or 0) >= PRIOR_ROWS
    prior = (labelled["t"] + 1) / (labelled["n"] + 10) if settled else 0.1
    model = LabelModel(prior, np.stack([np.full(n, 0.02), np.full(n, 0.3)]), np.eye(n))
    for _ in range(EM_ROUNDS):
        mass, products = weighted_sums(patterns, model)
        fired = np.stack([np.diag(p) for p in products])
        rates = np.clip((fired + np.array([[0.1], [0.2]])) / (mass[:, None] + 1), 1e-6, 1 - 1e-6)
        if not settled:
            prior = float(np.clip((mass[1] + 1) / (mass.sum() + 10), 1e-4, 0.5))
        model = LabelModel(prior, rates, np.eye(n))
    mass, products = weighted_sums(patterns, model)
    means = np.stack([np.diag(p) for p in products]) / np.maximum(mass, 1)[:, None]
    covariance = sum(products[c] - mass[c] * np.outer(means[c], means[c]) for c in (0, 1))
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
    correlations = covariance / np.outer(spread, spread)
    correlations[np.diag(covariance) <= 1e-9] = 0
    np.fill_diagonal(correlations, 1)
    return LabelModel(model.prior, model.rates, correlations)


def fit_linear(patterns: DataFrame, model: LabelModel, n: int) -> tuple[np.ndarray, float]:
    """Weights of the ``n`` features and the bias, which is not shrunk, from (hits, votes, rows).

    Logistic regression on the posteriors of all rows, by Newton steps. A step reads the patterns once where
    they are; the driver gets at most (n + 2)² numbers.
    """
    ridge = np.append(np.ones(n), 1e-6)
    w = np.zeros(n + 1)
    for _ in range(NEWTON_ROUNDS):

        def sums(frames: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            total = np.zeros((n + 2, n + 1))
            for frame in frames:
                rows = frame["rows"].to_numpy(np.float64)
                x = np.zeros((len(frame), n + 1))
                for row, own in enumerate(frame["hits"]):
                    x[row, own] = 1
                x[:, n] = 1
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:-1] += (x * (rows * (p * (1 - p) + 1e-9))[:, None]).T @ x
                total[-1] += x.T @ (rows * (p - model.posterior(frame["votes"].to_numpy())))
            i, j = np.nonzero(total)
            yield pd.DataFrame({"i": i, "j": j, "x": total[i, j]})

        found = patterns.mapInPandas(sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros((n + 2, n + 1))
        total[found["i"], found["j"]] = found["x"]
        step = np.linalg.solve(total[:-1] + np.diag(ridge), total[-1] + ridge * w)
        size = np.abs(step).max()
        w = w - step * min(1.0, 5 / max(1e-9, size))
        if size < 1e-6:
            break
    return w[:n], float(w[n])


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 0) -> ToxicityModel:
    """Fits on all documents' votes and on labels outside the held-out fold.

    Labels choose the features and are held in the label model; the classifier learns from the posteriors of
    all documents, labelled or not.

    Reads doc_id and text of ``docs``, doc_id and toxic of ``labels``. Documents without a label
    count as unknown, labels without a document not at all. Without any document or label the lexicons
    and patterns still vote, and every score stays low.
    """
    features = chosen_features(*mined_features(labelled_texts(docs, labels, held_out, LABELLED_ROWS)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = features.families()
        for batch in batches:
            own = [featurize(t, features, families) for t in batch.column(1).to_pylist()]
            hits, marks = pa.array([h for h, _ in own], pa.list_(pa.int32())), pa.array([v for _, v in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), hits, marks], ["doc_id", "hits", "votes"])

    voted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        votes, "doc_id long, hits array<int>, votes long"
    )
    known = known_labels(labels, held_out).withColumnRenamed("doc_id", "_id")
    voted = written(voted.join(known, F.col("doc_id") == F.col("_id"), "left").drop("_id"), "votes")
    patterns = voted.groupBy("votes", "toxic").agg(F.count("*").alias("rows"))
    model = fit_label_model(written(patterns, "vote-patterns"), features.n_voters)
    size = len(features.names) + len(PATTERNS)
    hits = voted.groupBy("hits", "votes").agg(F.count("*").alias("rows"))
    weights, bias = fit_linear(written(hits, "hit-patterns"), model, size)
    names = [*LEXICONS, *[f"stem {i}" for i in range(features.n_voters - len(LEXICONS) - len(PATTERNS))], *PATTERNS]
    clean, toxic = model.rates
    voters = pd.DataFrame(
        {
            "voter": names,
            "rate_toxic": toxic,
            "rate_clean": clean,
            "accuracy": model.prior * toxic + (1 - model.prior) * (1 - clean),
            "repeated": np.maximum(model.correlations, 0).sum(axis=1) - 1,
        }
    )
    return ToxicityModel(features, weights, bias, voters, model.correlations)


def rejection_threshold(docs: DataFrame, labels: DataFrame, model: ToxicityModel, lost: float = CLEAN_LOST) -> float:
    """The least score, in hundredths from 0.05 to 0.5, from which on at most a share ``lost`` of clean documents lies.

    Told by all documents labelled clean, of which one more than found is counted as lost: with few of them it is 0.5.
    Texts are scored where they are; ids and hundredths alone meet the labels.
    """
    clean = known_labels(labels, held_out=FOLDS).where("toxic = 0").select("doc_id")
    place = F.floor(F.col("score") * 100).cast("int").alias("at")
    places = score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", place)
    counts = {r["at"]: r["n"] for r in places.join(clean, "doc_id").groupBy("at").agg(F.count("*").alias("n")).collect()}
    for at in range(5, 50):
        if sum(n for k, n in counts.items() if k >= at) + 1 <= lost * (sum(counts.values()) + 1):
            return at / 100
    return 0.5


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability that a text is toxic; a column of that name is replaced.

    Only the text decides, whole whatever its length. Null and empty texts get the score of a text without any
    feature. Other columns and repeated rows pass through; a table without rows gives none.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        families = model.features.families()
        for part in texts:
            logits = [model.bias + float(model.weights[featurize(t, model.features, families)[0]].sum()) for t in part]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, dtype=np.float64), -40, 40))))

    return docs.withColumn(out, score("text"))
