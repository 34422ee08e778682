"""Page-intent classifier queries over the generated pages.

SQL cannot fit a model, so the queries return what SQL can state: the rows of each split with their labels, that the
model learned the four types, that exactly one candidate is kept, and that the stored model and vocabulary equal the
live ones. The metrics themselves come from ``operators.model``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortkit import constants as K
from cohortkit.operators import model as M
from cohortkit.operators import textprep as TP
from cohortkit.operators.pages import generate_pages, label_of
from cohortkit.plans.q_pages import SPLIT_H, TYPES_SQL
from cohortkit.plans.registry import ORACLE, register
from cohortkit.session import materialize, scratch_path
from cohortkit.sources.tables import load

SPLIT_SQL = f"""
SELECT sample_id, cast(label AS DOUBLE) AS label, row_number() OVER (ORDER BY h, sample_id) <= (count(*) OVER () + 4) // 5 AS is_test
FROM (SELECT sample_id, list_position({TYPES_SQL}, page_type) - 1 AS label, {SPLIT_H} AS h FROM ({ORACLE["gen_pages"]}) g) t"""

LEARNED = 0.9  # accuracy that the template pages, whose types differ in their markup, must reach


def _texts(spark, sf_dir):
    """Combined text and label of the generated pages."""
    pages = generate_pages(load(spark, sf_dir, "pages", "page_id", "html"))
    rows = TP.training_rows(pages.withColumn("label", label_of(F.col("page_type"))))
    return TP.combined(rows)


def _split(spark, sf_dir):
    """The labelled pages with ``is_test``, computed once."""
    rows = _texts(spark, sf_dir).select("sample_id", F.col("combined").alias("text"), F.col("label").cast("double").alias("label"))
    return materialize(TP.split_exact(rows))


@register("classifier_eval", f"""
SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows, true AS learned
FROM ({SPLIT_SQL}) s GROUP BY is_test""")
def q_classifier_eval(spark, sf_dir):
    """Rows per split, and whether the classifier learned the types on it."""
    _, metrics = M.fit_evaluate(spark, _split(spark, sf_dir))
    return metrics.select("split", "n_rows", (F.col("accuracy") >= LEARNED).alias("learned"))


@register("classifier_select", f"""
SELECT 3 AS n_candidates, 1 AS n_best, true AS best_is_lowest, (SELECT count(*) FROM ({SPLIT_SQL}) s WHERE is_test) AS n_test""")
def q_classifier_select(spark, sf_dir):
    """Candidates by number of passes, of which one is kept."""
    split = _split(spark, sf_dir)
    _, scores = M.fit_best(spark, split)
    least = scores.agg(F.min("log_loss")).scalar()
    return scores.agg(
        F.count(F.lit(1)).cast("int").alias("n_candidates"), F.count_if("is_best").cast("int").alias("n_best"),
        F.bool_and(~F.col("is_best") | (F.col("log_loss") == least)).alias("best_is_lowest"),
        F.lit(split.filter("is_test").count()).cast("bigint").alias("n_test"))


@register("model_roundtrip", f"""
SELECT sample_id, label, true AS same_prediction, true AS same_vocabulary FROM ({SPLIT_SQL}) s WHERE is_test""")
def q_model_roundtrip(spark, sf_dir):
    """Test rows scored by the best model and by its stored copy; the vocabulary as stored."""
    split = _split(spark, sf_dir)
    test = split.filter("is_test")
    model, _ = M.fit_best(spark, split)
    vocab = materialize(TP.vocabulary(_texts(spark, sf_dir)))
    path = scratch_path(spark, "page_intent_model")
    M.save(model, vocab, path)
    stored, stored_vocab = M.load(spark, path)
    live = model.transform(test).select(F.col("sample_id").alias("id"), F.col("prediction").alias("live"))
    other = vocab.exceptAll(stored_vocab).unionAll(stored_vocab.exceptAll(vocab)).agg(F.count(F.lit(1))).scalar()
    return stored.transform(test).join(live, F.col("sample_id") == F.col("id")).select(
        "sample_id", "label", (F.col("prediction") == F.col("live")).alias("same_prediction"), (other == 0).alias("same_vocabulary"))


@register("classifier_epochs")
def q_classifier_epochs(spark, sf_dir):
    """A line per epoch of the classifier over sub-words, trained on the pages of the grammar, with the loss of the best one as its stored
    state gives it (X5, X6). SQL cannot fit it; tests hold it against numpy."""
    from cohortkit.operators import epochs as EP
    from cohortkit.operators import subword as SW
    from cohortkit.operators.grammar import generate_varied_pages
    from cohortkit.plans.q_subword import VOCABULARY

    pieces = SW.read_vocabulary(VOCABULARY)
    pages = generate_varied_pages(load(spark, sf_dir, "pages", "page_id", "html"))
    texts = TP.combined(TP.training_rows(pages.withColumn("label", label_of(F.col("page_type")))))
    encoded = SW.encode_subwords(texts, pieces)
    rows = EP.deal(TP.split_exact(encoded.select("sample_id", "label", "input_ids")))
    path = scratch_path(spark, "page-intent-epochs")
    n_classes = len(K.PAGE_TYPES)
    report = EP.fit_epochs(spark, rows, path, max(pieces.values()) + 1, n_classes)
    best = report.where("is_best").first()
    again = EP.evaluate(EP._of_step(spark, rows, EP.TEST_STEP), EP.load_state(spark, path, best["epoch"]))["loss"] if best else None
    return report.withColumn("reloaded_loss", F.when(F.col("is_best"), F.lit(again).cast("double")))
