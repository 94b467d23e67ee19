"""Prompts, completions, tokens, choice and pairs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from echoloom.config import Choice, MiningConfig, parse_config
from echoloom.functions import bytelevel, scalar
from echoloom.operators import choose, features, pairs, repetition, tokens
from echoloom.plans.mine import run_mining
from echoloom.plans.training_data import merged_dir, model_names, prepare, steps
from echoloom.config import TrainingConfig
from echoloom.sources import readers


def test_config():
    c = parse_config({"generation": {"target_pairs": 5, "input_jsonl": "a.jsonl"}, "train": None})
    assert c.generation.target_pairs == 5 and c.generation.input_jsonl.name == "a.jsonl" and c.train.batch_size == 1
    for bad in ([], {"other": 1}, {"train": 3}):
        with pytest.raises(ValueError):
            parse_config(bad)
    with pytest.raises(TypeError):
        parse_config({"train": {"unknown": 1}})
    whole = parse_config({"model_name": "org/m", "generation": {"api_base_url": "http://x", "hf_dataset": "some/set", "hf_source_values": ["a"], "chosen_top_k": 7, "chosen_skip_raw_token_substrings": ["<"], "repetition": None, "top_k": 50}, "train": {"lora_r": 8, "optim": "x", "seed": 1}})
    assert whole.generation.choice() == Choice(top_k=7, skip_raw_token_substrings=("<",)) and whole.generation.thresholds().min_repeats == 4 and str(whole.generation.dataset_path) == "some/set"
    assert whole.generation.outside == {"api_base_url": "http://x", "top_k": 50} and whole.train.outside == {"lora_r": 8, "optim": "x"} and whole.generation.source_values == ["a"]


def test_prompts(spark, tmp_path):
    rows = [{"conversations": "plain", "source": "x"}, {"conversations": [{"role": "user", "content": "hi"}], "source": "x"}, {"conversations": [{"from": "human", "value": "a"}, {"from": "odd"}], "source": "care"}, {"conversations": "n", "source": None}, {"conversations": "m"}, {"conversations": [], "source": "y"}, {"conversations": "s", "source": "my-BFCL"}]
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join([json.dumps(r) for r in rows] + ["", "   "]))
    got = readers.load_prompts(spark, input_jsonl=str(path), skip=["bfcl"]).collect()
    assert [(r["text"], r["source"]) for r in got] == [("plain", "x"), ("", "x"), ("", "care"), ("n", "None"), ("m", ""), ("[]", "y")]
    assert got[1]["chat_messages"][0]["content"] == "hi" and [m["role"] for m in got[2]["chat_messages"]] == ["user", "user"]
    formatted = readers.load_prompts(spark, input_jsonl=str(path), limit=2).select(readers.format_prompt(F.col("text"), F.col("chat_messages"), "<{prompt}>").alias("p")).collect()
    assert [r["p"] for r in formatted] == ["<plain>", "<user: hi>"]
    assert readers.load_prompts(spark, input_jsonl=str(path), source_values=["care"]).count() == 1
    with pytest.raises(ValueError):
        readers.load_prompts(spark)
    path.write_text("{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load_prompts(spark, input_jsonl=str(path)).collect()


def test_byte_tokens(spark):
    assert bytelevel.decode("Ġthe") == " the" and bytelevel.decode("Ċ") == "\n" and bytelevel.decode("▁x") == " x" and bytelevel.decode("Ã©") == "é" and bytelevel.decode("") == ""
    assert bytelevel.decode("中") == "中" and bytelevel.decode("Ã") == "Ã"
    rows = spark.createDataFrame([(["Ġa", "b", "", "cd"],)], "tokens array<string>")
    rows = tokens.with_decoded(rows)
    assert rows.first()["decoded_text"] == " abcd"
    for at, want in ((-1, None), (0, 0), (1, 0), (2, 1), (3, 3), (4, 3), (5, None)):
        assert rows.select(tokens.token_index(F.col("decoded"), F.lit(at)).alias("k")).first()["k"] == want
    spans = tokens.token_spans(rows.withColumn("id", F.lit(1)), "id")
    assert [(r["char_start"], r["char_end"]) for r in spans.orderBy("idx").collect()] == [(0, 2), (2, 3), (3, 3), (3, 5)]
    several = spark.createDataFrame([(1, ["ab", "é中", None]), (2, None), (3, []), (4, ["", "x"])], "id int, decoded array<string>").coalesce(1)
    assert [tuple(r) for r in tokens.token_spans(several, "id").select("id", "idx", "char_end").collect()] == [(1, 0, 2), (1, 1, 4), (1, 2, 4), (4, 0, 0), (4, 1, 1)]


def plain_choice(options, rejected, temperature, c):
    items = [(t, math.exp(lp) ** (1 / max(temperature, 1e-6))) for t, lp in options if lp is not None]
    total = sum(p for _, p in items)
    if total <= 0:
        return []
    items = [(t, p / total) for t, p in items if t != rejected and bytelevel.decode(t).lower() != bytelevel.decode(rejected).lower()]
    if c.min_p is not None and items:
        best = max(p for _, p in items)
        items = [x for x in items if x[1] >= c.min_p * best]
    if c.top_k is not None:
        items = sorted(items, key=lambda x: -x[1])[: c.top_k] if len(items) > c.top_k else items
    items = sorted(items, key=lambda x: x[1])
    out = [t for t, _ in items if not any(s in t for s in c.skip_raw_token_substrings) and len(bytelevel.decode(t).strip()) >= c.min_decoded_chars and (not c.require_alnum or any(x.isalnum() for x in bytelevel.decode(t)))]
    return out[: c.max_tokens]


@pytest.mark.parametrize("c,t", [(Choice(), 1.0), (Choice(min_p=0.3, top_k=3), 0.7), (Choice(require_alnum=True, skip_raw_token_substrings=("b",), max_tokens=2), 0.2), (Choice(), 1e-4)])
def test_choice(spark, c, t):
    options = [("Ġa", -1.0), ("a", -1.0), ("Ġb", -2.0), ("!", -0.5), ("Ġ", -0.1), ("ĠA", -3.0), ("z", None), ("ab", -2.0), ("c9", -5.0)]
    for rejected in ("Ġa", "!", "q"):
        rows = spark.createDataFrame([([(k, o, lp) for k, (o, lp) in enumerate(options)], rejected)], "options array<struct<ord:int,tok:string,lp:double>>, rejected string")
        got = choose.with_choice(rows, "options", "rejected", t, c).first()["chosen"]
        assert [x["tok"] for x in got] == plain_choice(options, rejected, t, c)


def response(toks, alternatives, text=""):
    return json.dumps({"choices": [{"text": text, "logprobs": {"tokens": toks, "top_logprobs": alternatives}}]})


def test_mining(spark, tmp_path):
    unit = ["Wait", ",", "Ġlet", "Ġme", "Ġre", "consider", "."]
    toks = ["Let", "Ġme", "Ġsolve", "Ġthis", ".", "Ġ"] + (unit + ["Ġ"]) * 6
    alternatives = [{"So": -1.0, t: -0.2, "Now": -2.0} for t in toks]
    alternatives[0] = None
    rows = [("a", "p1", response(toks, alternatives)), ("a", "p2", json.dumps({"choices": [{"text": "loop and loop. " * 20}]})), ("b", "p3", json.dumps({"choices": []})), ("b", "p4", response(toks, [{}] * len(toks)))]
    completions = readers.parse_completions(spark.createDataFrame(rows, "source string, prompt string, response string"))
    made = pairs.build_pairs(completions, 1.0).collect()
    assert len(made) == 1
    p = made[0]
    index = p["repetition"]["rejected_token_index"]
    assert p["rejected_token"] == toks[index] and p["context_before"] == "p1" + "".join(map(bytelevel.decode, toks[:index])) and p["multi_chosen_tokens"] == ["Now", "So"]
    report = run_mining(completions, str(tmp_path / "run"), MiningConfig(temperature=1.0))
    assert report == {"n_texts": 4, "n_loops": 3, "loop_rate": 75.0, "n_pairs": 1, "n_failed": 0}
    broken = readers.parse_completions(spark.createDataFrame([*rows, ("c", "p5", "{broken"), ("c", "p6", None), ("c", "p7", "[1]")], "source string, prompt string, response string"))
    assert run_mining(broken, str(tmp_path / "run2"), MiningConfig(temperature=1.0)) == {**report, "n_failed": 3}
    letters = spark.read.json(str(tmp_path / "run2" / "failed")).collect()
    assert sorted((r["prompt"], r["error_class"]) for r in letters) == [("p5", "MalformedResponse"), ("p6", "MalformedResponse"), ("p7", "MalformedResponse")]
    ready = prepare(readers.read_pairs(spark, str(tmp_path / "run" / "pairs")), lambda: lambda t: [len(w) for w in t.split()] or [0], TrainingConfig(filter_rejected_stop_words=False))
    assert ready.features.count() == 1 and ready.by_source.first()["source_label"] == "__unknown__"
    assert steps(TrainingConfig(num_epochs=2), 17) == 3 and merged_dir("runs/merged", "n") == "runs/n"


def test_a_row_that_raises_is_counted_and_the_others_go_on(spark, tmp_path, monkeypatch):
    """The detector fails on one text and the decoder on another: each is a row of its own among the failed ones."""
    plain_detect, plain_decode = repetition.detect, bytelevel.decode
    monkeypatch.setattr(repetition, "detect", lambda t, r: 1 / 0 if t and "poison" in t else plain_detect(t, r))

    def decode(token):
        if token == "bad":
            raise KeyError(token)
        return plain_decode(token)

    monkeypatch.setattr(bytelevel, "decode", decode)
    rows = [("a", "p1", json.dumps({"choices": [{"text": "poison"}]})), ("a", "p2", response(["bad"], [None])), ("a", "p3", json.dumps({"choices": [{"text": "loop and loop. " * 20}]})), ("b", "p4", "{")]
    completions = readers.parse_completions(spark.createDataFrame(rows, "source string, prompt string, response string"))
    report = run_mining(completions, str(tmp_path / "run"), MiningConfig(temperature=1.0))
    assert report == {"n_texts": 1, "n_loops": 1, "loop_rate": 100.0, "n_pairs": 0, "n_failed": 3}
    letters = spark.read.json(str(tmp_path / "run" / "failed")).collect()
    assert sorted((r["prompt"], r["error_class"]) for r in letters) == [("p1", "ZeroDivisionError"), ("p2", "KeyError"), ("p4", "MalformedResponse")]
    assert [r["prompt"] for r in spark.read.json(str(tmp_path / "run" / "generations")).collect()] == ["p3"]


def test_names(spark):
    assert [scalar.format_number(x) for x in (1e-6, 1.5e-5, 0.4, 1e20, 12345678.9)] == ["1e-6", "1.5e-5", "0.4", "1e20", "12345679"]
    assert scalar.format_epochs(2.0) == "2" and scalar.format_epochs(0.5) == "0.5" and scalar.top_counts([]) == "none" and scalar.top_counts([("b", 1), ("a", 1), ("c", 2)], 2) == "c=2, a=1"
    rows = spark.createDataFrame([("org/base-8B_17_HF_x/",), ("plain",), ("m-3b-v2",)], "name string")
    got = rows.select(scalar.base_name("name").alias("b"), scalar.model_size("name").alias("s"), scalar.parent_id("name").alias("p")).collect()
    assert [tuple(r) for r in got] == [("base-8B_17_HF_x", "8B", "17"), ("plain", "model", "unknown"), ("m-3b-v2", "3b", "2")]
    assert model_names(rows, "name", user="a b", job="local", examples=3, rate=1e-6, epochs=1).first()["merged_name"] == "a-b_prefs8B_from17_3-samples_lr1e-6_ep1_local_HF"


def test_cascade(spark):
    rows = [("", "a", "a", ["x"]), ("w " * 20, "a", "a", ["x"]), ("c", "", "", ["x"]), ("c", "a b", "a b", ["x"]), ("c", "the", " The,", ["x"]), ("c", "a1", "a1", []), ("c", "a1", "a1", None), ("c", "a1", "a1", ["x y"]), ("c d", "a1", "a1", ["x y", "z"]), (None, "a", "a", ["x"])]
    df = spark.createDataFrame([(*r, r[3]) for r in rows], "context_before string, rejected_token string, rejected_decoded string, multi_chosen_tokens array<string>, multi_chosen_decoded array<string>")
    got = features.tokenise(df, lambda: lambda t: [len(w) for w in t.split()], max_length=10).collect()
    assert [r["reject_reason"] for r in got] == ["empty_context", "over_length", "no_rejected", "rejected_not_single", "rejected_stopword", "no_chosen", "no_chosen", "chosen_not_single", None, "empty_context"]
    assert got[8]["chosen_decoded"] == ["z"] and got[8]["chosen_ids"] == [1]
    many = [("w%d" % k if k % 3 else "same") for k in range(60)]
    thin = spark.createDataFrame([([(k, w) for k, w in enumerate(many)],)], "c array<struct<id:int,decoded:string>>").select(features.thin_chosen(F.col("c")).alias("c")).first()["c"]
    assert all(x["decoded"] != "same" for x in thin) and len(thin) == 40
    padded = spark.range(1).select(features.pad_left(F.array(F.lit(5).cast("bigint"), F.lit(6).cast("bigint")), 5, 0).alias("p"), features.position_ids(F.lit(2), 5).alias("i")).first()
    assert padded["p"] == [0, 0, 0, 5, 6] and padded["i"] == [0, 0, 0, 0, 1]


def test_command_line(spark, tmp_path):
    """Prompts, then pairs of completions, then features with their reports."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    from echoloom import cli

    unit = ["Wait", ",", "Ġlet", "Ġme", "Ġre", "consider", "."]
    toks = ["Let", "Ġme", "Ġsolve", "Ġthis", ".", "Ġ"] + (unit + ["Ġ"]) * 6
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"conversations": f"q{k}", "source": "s"}) for k in range(5)))
    (tmp_path / "c.yaml").write_text(f"model_name: org/base-3B\ngeneration:\n  input_jsonl: {tmp_path}/p.jsonl\n  max_prompts: 3\n  prompt_template: '<{{prompt}}>'\n  temperature: 1.0\n  api_key: x\ntrain:\n  filter_rejected_stop_words: false\n  lora_r: 4\n")
    run = str(tmp_path / "run")
    base = ["-c", str(tmp_path / "c.yaml"), "-r", run]
    assert cli.main(base) == 0
    assert [r["prompt"] for r in spark.read.json(f"{run}/prompts").orderBy("prompt").collect()] == ["<q0>", "<q1>", "<q2>"]
    rows = [("s", "<q0>", response(toks, [{t: -0.2, "So": -1.0, "Now": -2.0} for t in toks])), ("s", "<q1>", "{broken")]
    spark.createDataFrame(rows, "source string, prompt string, response string").write.parquet(str(tmp_path / "done.parquet"))
    words = {w: k for k, w in enumerate(["So", "Now", "Wait", "x"])}
    tokenizer = Tokenizer(models.WordLevel(words, unk_token="x"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "t.json"))
    assert cli.main([*base, "--train-only"]) == 1
    assert cli.main([*base, "--completions", str(tmp_path / "done.parquet"), "--tokenizer", str(tmp_path / "t.json")]) == 0
    summary = spark.read.json(f"{run}/reports/summary").first()
    assert summary["examples"] == 1 and summary["steps"] == 1 and summary["merged_name"] == "local_prefs3B_from3_1-samples_lr1e-6_ep1_local_HF"
    assert {r["reason"]: r["n"] for r in spark.read.json(f"{run}/reports/reasons").collect()} == {"kept": 1}
    assert cli.main([*base, "--generate-only", "--train-only"]) == 0
