"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on a document's counts. Measures that see the same fault of a text (signs,
marked words and loose bars; repeated windows, runs of a word and few distinct words; capitals and shouted words) share one
rule, so that one fault isn't counted twice by votes that the model takes for independent. The corpus is reduced to the number
of documents for each pattern of votes, at most 3 ** len(RULES) rows at any size; EM over that table estimates how each rule
votes on good and on bad documents and how many documents are good, without labels; a pattern's posterior probability then
decides for its documents, and replaces the demand that every rule be passed.

Defined results: a null or empty text has no words and fails the base rules; repeated rows get equal verdicts; a posterior of
exactly one half counts as good; an empty table gives an empty result; whole texts of any length are counted; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import chunks, id_text, materialize
from geoloom.llm.textstats import FIELDS, stats

#: How a rule votes (bad, abstains, good) on bad and on good documents before the corpus is seen. With the weight of PRIOR of
#: all documents it also keeps the two classes in place; it weighs the same at every size of the corpus.
EXPECTED = ((0.3, 0.2, 0.5), (0.02, 0.18, 0.8))
PRIOR = 0.05
STATS_DDL = "doc_id long, " + ", ".join(f"{x} long" for x in FIELDS)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of textstats for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            rows = np.array([stats(x) for x in texts], np.int64).reshape(len(texts), len(FIELDS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(FIELDS)))], names=["doc_id", *FIELDS])

    return id_text(docs).mapInArrow(run, STATS_DDL)


def share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))


def vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote as a column over the counts."""
    words = F.col("n_words")
    repeat, symbols, dup = share("n_repeat_words", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines")
    length, same, upper = share("word_chars", "n_words"), share("n_same_next", "n_words"), share("n_upper", "n_letters")
    shouted, marked, bars = share("n_upper_words", "n_words"), share("n_symbol_words", "n_words"), share("n_loose_bars", "n_words")
    stop, distinct, ended = share("n_stop", "n_words"), share("n_distinct", "n_words"), share("n_ended", "n_lines")
    return {
        "enough_words": vote(words, words < 50, words >= 150),
        "little_repetition": vote(repeat, (repeat > 0.5) | (same > 0.1) | ((distinct < 0.2) & (words < 400)), (repeat < 0.15) & (same < 0.04)),
        "few_symbols": vote(symbols, (symbols > 0.1) | (marked > 0.05) | (bars > 0.03), (symbols < 0.02) & (marked < 0.01) & (bars < 0.005) & (words >= 20)),
        "few_dup_lines": vote(dup, dup > 0.3, dup < 0.1),
        "usual_word_length": vote(length, (length < 2.5) | (length > 12), (length > 3.5) & (length < 9)),
        "mostly_lower_case": vote(upper, (upper > 0.3) | (shouted > 0.1), (upper < 0.1) & (shouted < 0.03)),
        "stop_words": vote(stop, (stop < 0.005) & (words >= 50), stop > 0.05),
        "ended_lines": vote(ended, ended < 0.2, ended > 0.7),
    }


def fit_em(votes: np.ndarray, counts: np.ndarray, steps: int = 500, prior: float = 0.85) -> tuple[np.ndarray, float, np.ndarray]:
    """(rates[rule, class, vote], share of good documents, posterior of each pattern).

    A rule has an accuracy for each class: how often it votes bad, abstains and votes good on bad (class 0) and on good
    documents (class 1), the modes under a Dirichlet prior that stands for PRIOR of all documents voting as EXPECTED.
    """
    hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    expected = np.broadcast_to(np.array(EXPECTED), (votes.shape[1], 2, 3))
    rates, post, total = expected, np.full(len(votes), prior), counts.sum()
    for _ in range(steps):
        fit = np.einsum("prv,rcv->pc", hot, np.log(rates)) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(fit[:, 0] - fit[:, 1], -500, 500)))
        weight = np.stack([1 - post, post], 1) * counts[:, None]
        new = np.einsum("prv,pc->rcv", hot, weight) + PRIOR * total * expected
        new /= new.sum(2, keepdims=True)
        prior = float(((post * counts).sum() + 0.5 * PRIOR * total) / ((1 + PRIOR) * total))
        if np.abs(new - rates).max() < 1e-9:
            break
        rates = new
    return rates, prior, post


def judge(docs: DataFrame) -> DataFrame:
    """The counts, base_failed, the votes' pattern (0 to 3 ** len(rules()) - 1), the posterior quality and kept for each document."""
    names = list(rules())
    table = document_stats(docs)
    code = sum(((v + 1) * 3**k for k, v in enumerate(rules().values())), F.lit(0))
    table = materialize(table.withColumn("pattern", code.cast("int")), "quality-stats")
    seen = sorted((r[0], r[1]) for r in table.groupBy("pattern").count().collect())  # at most 3 ** len(RULES) rows, each of two numbers
    patterns = np.array([p for p, _ in seen], np.int64)
    votes = patterns[:, None] // 3 ** np.arange(len(names)) % 3 - 1
    post = fit_em(votes, np.array([n for _, n in seen], float))[2] if seen else np.empty(0)
    weights = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post, strict=True)], "pattern int, quality double")
    repeated = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return table.join(F.broadcast(weights), "pattern").withColumn("base_failed", (F.col("n_words") < 50) | repeated).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
