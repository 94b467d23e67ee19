"""Physical plans: what runs once, and what needs no shuffle."""

import pytest

from echoloom import queries as core


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["loop_hits", "loop_hits_loose", "generation_records", "loop_rate_by_source"])
def test_detector_runs_once_a_row(spark, small_dir, name):
    assert plan(core.queries()[name](spark, small_dir)).count("ArrowEvalPython") == 1


def test_shared_counts_are_not_computed_again(spark, small_dir):
    df = core.queries()["starter_share"](spark, small_dir)
    df.collect()
    final = plan(df).partition("Initial Plan")[0]
    assert final.count("ArrowEvalPython") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("name", ["token_spans", "char_to_token", "context_before", "choose_tokens", "filter_cascade", "generation_records"])
def test_row_operators_need_no_shuffle(spark, small_dir, name):
    text = plan(core.queries()[name](spark, small_dir))
    assert "Exchange" not in text and "Window" not in text


def test_columns_and_filters_reach_the_scan(spark, small_dir):
    text = plan(core.queries()["skip_filter"](spark, small_dir))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text
    assert "In(source" in plan(spark.read.parquet(f"{small_dir}/documents.parquet").filter("source IN ('src1', 'src2')").select("doc_id"))


def test_sampling_reads_the_pairs_three_times(spark, small_dir):
    """Once for the stored counts, before this plan, and twice in it; nothing goes to a single partition."""
    text = plan(core.queries()["regularised_sample"](spark, small_dir))
    assert text.count("documents.parquet") <= 2 and "SinglePartition" not in text


def test_mining_decodes_and_detects_once_a_row(spark, small_dir):
    """One detector, and the decoder once for tokens and once for the options of the place; a response is parsed once."""
    text = plan(core.queries()["mined_by_source"](spark, small_dir))
    assert text.count("ArrowEvalPython") == 3 and text.count("FileScan") == 1 and text.count("from_json") == 1 and "get_json_object" not in text
    assert text.count("run(") == 3
    text = plan(core.queries()["parse_completions"](spark, small_dir))
    assert text.count("from_json") == 1 and "get_json_object" not in text and "json_object_keys" not in text


def test_prompts_are_parsed_once_into_a_variant(spark, small_dir):
    text = plan(core.queries()["prompts_of_sources"](spark, small_dir))
    assert text.count("parseJson") == 1 and "from_json" not in text and "get_json_object" not in text


@pytest.mark.parametrize("name", ["mined_by_source", "mined_pairs"])
def test_alternatives_wait_in_no_queue(spark, small_dir, name):
    """Rows are queued for Python with all their columns; alternatives, the widest, are packed before."""
    above, packs, _ = plan(core.queries()[name](spark, small_dir)).partition("MapInArrow")
    assert packs and above.count("ArrowEvalPython") == 3 and "alternatives" not in above


def test_batches_are_taken_some_rows_at_a_time():
    import pyarrow as pa

    from echoloom.functions.bytelevel import sliced

    seen = []
    got = sliced(lambda a: (seen.append(len(a)), pa.array([len(x or []) for x in a.to_pylist()]))[1], pa.array([[1] * (k % 3) if k % 7 else None for k in range(600)]))
    assert seen == [256, 256, 88] and got.to_pylist() == [k % 3 if k % 7 else 0 for k in range(600)]
    assert sliced(lambda a: a, pa.array([], pa.string())).to_pylist() == []


def test_decoding_of_null_lists_and_tokens(spark):
    from echoloom.functions.bytelevel import decode_tokens

    rows = [(["Ġa", None, "", "Ġa"],), (None,), ([],), (["Ċ"],)]
    for checked in (False, True):
        got = [r[0] for r in spark.createDataFrame(rows, "x array<string>").coalesce(1).select(decode_tokens("x", checked=checked)).collect()]
        assert [g["value"] if checked else g for g in got] == [[" a", None, "", " a"], None, [], ["\n"]]


@pytest.mark.parametrize("name", ["mined_by_source", "mined_pairs"])
def test_only_packed_binaries_wait_for_python(spark, small_dir, name):
    """Neither the response's text nor lists of tokens go beyond the packing, and a text without a loop waits for no place."""
    above, _, packs = plan(core.queries()[name](spark, small_dir)).partition("MapInArrow")
    outputs = packs.partition("\n")[0].rpartition("[")[2]
    assert "response" not in outputs and " tokens#" not in outputs and "doc_id" not in outputs
    last = above.partition("ArrowEvalPython")[0] + above.partition("ArrowEvalPython")[2].partition("Generate")[0]
    assert "Generate" in above and "__packed" not in last and " decoded#" not in above


def test_packed_rows_are_small_and_whole():
    import pyarrow as pa

    from echoloom.functions.bytelevel import _Memory
    from echoloom.operators import pairs

    toks = [["a", "é中", "", None, "b"], None, [], ["x"] * 3, ["", "\U0001f600"]]
    option = lambda k, t, lp: {"ord": k, "tok": t, "lp": lp}
    places = [[{"idx": 1, "options": [option(0, "é中", -1.0), option(1, "q", None)]}, {"idx": 4, "options": [option(3, "zé", 0.5), option(1, "", 0.5)]}], None, [], [{"idx": 2, "options": None}, {"idx": 0, "options": []}], [{"idx": 1, "options": [option(0, "u", 2.0)]}]]
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("options", pairs._ARROW_OPTIONS)]))
    for first in (0, 2, 3):  # slices too
        t, a = pa.array(toks, pa.list_(pa.string()))[first:], pa.array(places, kind)[first:]
        packed = list(zip(t.to_pylist(), a.to_pylist(), pairs._packed_tokens(t).to_pylist(), pairs._packed_places(a).to_pylist(), strict=True))
        for tokens, alternatives, x, y in packed:
            assert (x is None) == (not tokens) and (y is None) == (not alternatives)
            for k in range(len(tokens or [])):
                got = pairs._place(x, y, k, _Memory())
                assert got["rejected"] == tokens[k] and got["options"] == next((p["options"] or [] for p in alternatives if p["idx"] == k), [])
        assert pairs._tokens([x for _, _, x, _ in packed if x]).to_pylist() == [x for x in t.to_pylist() if x]
    words = [f"word{k * k}" for k in range(2000)]
    many = pa.array([[{"idx": k, "options": [option(j, w + e, -float(j)) for j, e in enumerate(("", "1", "2", "b"))]} for k, w in enumerate(words)]], kind)
    assert len(pairs._packed_places(many)[0].as_py()) < 0.15 * many.nbytes  # offsets alone would take more


def test_a_memory_of_tokens_stays_small():
    from echoloom.functions.bytelevel import _Memory

    known = _Memory()
    assert [known[f"Ġ{k}"] for k in range(100_000)] == [f" {k}" for k in range(100_000)] and len(known) <= 1 << 16
