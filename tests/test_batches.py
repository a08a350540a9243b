"""Batches cut by the bytes of their texts."""

from __future__ import annotations

import pyarrow as pa

from tessera.functions import batches, text
from tessera.sources import readers


def test_slices_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 10)
    texts = ["é" * 3, None, "abc", "x" * 25, "", "ab", "c" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["k", "t"])
    seen = []

    def told(rows):
        seen.append(rows.column("t").to_pylist())
        return rows

    out = list(batches.sliced(iter([batch, batch.slice(5), batch.slice(0, 0)]), "t", told))
    assert seen == [texts[:3], ["x" * 25, ""], ["ab"], ["c" * 10], ["ab"], ["c" * 10]] or seen == [texts[:3], ["x" * 25], ["", "ab"], ["c" * 10], ["ab"], ["c" * 10]]
    assert pa.Table.from_batches(out)["k"].to_pylist() == [*range(7), 5, 6]


def test_sliced_texts_are_parsed_and_chunked_whole(spark, monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 50)
    texts = {f"f{i}": f"---\nslug: s{i}\ntags: [a, b{i}]\n---\n\n# H{i}\n" + "line é\n" * (i * 40) for i in range(20)} | {"none": None, "bad": "---\na: [\n---\nx"}
    rows = spark.createDataFrame([*texts.items()], "path string, text string").coalesce(1)
    found = readers.parse_markdown(rows)
    assert "MapInPandas" not in found._jdf.queryExecution().toString()
    parsed = {r.path: r for r in found.collect()}
    for k, t in texts.items():
        meta, lists, body, error = readers.front_matter(t)
        assert (parsed[k].text, parsed[k].meta, parsed[k].lists, parsed[k].body, parsed[k].error) == (t, meta, lists, body, error)
    chunked = text.chunk_markdown(rows, "path", "text", 200)
    assert "MapInPandas" not in chunked._jdf.queryExecution().toString()
    told = sorted((r.source, r.n, r.content, r.heading, r.heading_level, r.start_line, r.end_line) for r in chunked.collect())
    assert told == sorted((k, n, *c) for k, t in texts.items() if t for n, c in enumerate(text.chunks_of(t, 200)))
