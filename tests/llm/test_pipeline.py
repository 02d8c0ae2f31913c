from __future__ import annotations

from collections import Counter

import numpy as np

from tests.llm.test_llm import SCHEMA, brute_components, check_packing, corpus, toxic_rows


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from rollcall.llm import tokens, toxicity

    rows, labels = toxic_rows(400)
    rows += [(1000 + i, t) for i, t in corpus(12)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.predicted}
    assert 30 <= len(toxic) <= 70
    clean = [(i, t) for i, t in rows if i not in toxic]
    one = brute_components(clean, 5, 80)
    kept = [(i, t) for i, t in clean if one[i][1] == i]
    count = Counter()
    for _, t in kept:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    tk, want = tokens.tokenizer(tokens.vocabulary_path()), {}
    for i, t in kept:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
        want[i] = len(tk.encode(text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert dict(got) == want
    check_packing(out, 2048)
    assert np.all([r.length <= 2048 for r in out]) and SCHEMA
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]
