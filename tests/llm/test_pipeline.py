from collections import Counter

import corpus_pipeline

from spindle.llm import op8_toxicity

from .edges import documents, empty
from .test_lines import key
from .test_packing import held, pieces_by_hand
from .test_pseudonyms import replaced_by_hand
from .test_simhash import alike_by_hand


def test_against_a_plain_version(spark, small):
    place = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    chain = op8_toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if chain.predict(chain.features(t, {})[None])[0, -1] < chain.threshold]
    counts = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")} if k)
    rows = [(d, "\n".join(x for x in t.split("\n") if counts[key(x)] < 10)) for d, t in rows]
    stays = {min(group) for group in alike_by_hand(rows)}
    rows = [(d, t) for d, t in rows if d in stays]
    got = corpus_pipeline.run(spark, place).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(pieces_by_hand([(d, replaced_by_hand(t)) for d, t in rows]))
    held(got)


def test_stages_keep_the_columns(spark, small):
    docs = documents(spark, extra=True)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert out.count() <= docs.count()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), small).count() == 0, name


def test_clean_documents_pass_the_toxicity_stage(spark, small):
    place = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, place).select("doc_id").collect()}
    clean, toxic = ({r.doc_id for r in labels.where(f"toxic = {k}").collect()} for k in (0, 1))
    assert len(clean & kept) > 0.99 * len(clean) and len(toxic & kept) < 0.15 * len(toxic)
