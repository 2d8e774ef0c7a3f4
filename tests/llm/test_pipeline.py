import re
import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from tidemark.llm import decontaminate
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import stored, table


def test_stages_on_a_small_folder(spark, folder):
    docs = table(spark, folder, "documents")
    kept = {0: {r["doc_id"]: r["text"] for r in docs.collect()}}
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frame = stored(stage(spark, frame, folder), f"stage-{k}")
        assert frame.columns == docs.columns
        kept[k + 1] = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert set(kept[k + 1]) <= set(kept[k])
    # Filters hand texts on as they are; near duplicates leave one of equal texts.
    assert all(kept[2][i] == kept[0][i] for i in kept[2])
    assert len(set(kept[2].values())) == len(kept[2]) and set(kept[1].values()) >= set(kept[2].values())
    # No item's window is left.
    found, match = decontaminate.find_matches(spark.createDataFrame(list(kept[3].items()), "doc_id long, text string"), table(spark, folder, "benchmark"))
    assert found.where(f"size({match}.spans) > 0").count() == 0
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(count(kept[4][i]) <= 2 * count(kept[3][i]) for i in kept[4])
    from tokenizers import Tokenizer

    own, start, expected = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in sorted(kept[4]):
        ids = np.array([*own.encode(kept[4][i], add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, folder)
    assert sorted(map(tuple, last.collect())) == expected


def test_registered_queries(spark, duck, folder):
    registered, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    names = [n for n in registered if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registered
    for name in (n for n in names if n in sql):
        result = duck.execute(sql[name])
        columns = sorted(d[0] for d in result.description)
        frame = registered[name](spark, folder)
        assert sorted(frame.columns) == columns
        order = [d[0] for d in result.description]
        expected = sorted((tuple(r[order.index(c)] for c in columns) for r in result.fetchall()), key=repr)
        assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) == expected
