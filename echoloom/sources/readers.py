"""Reading prompts, completions and pairs; writing JSON lines.

A prompt field can be a text, a list of (role, content) or a list of (from, value) messages; rows of one file can
differ, so lines are read as text and parsed with the schemas of each form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import holds_any

MESSAGES = "array<struct<role:string,content:string>>"
PAIR = (
    "context_before string, rejected_token string, rejected_decoded string, multi_chosen_tokens array<string>, multi_chosen_decoded array<string>, source string, source_prompt string, "
    "repetition struct<start_char:int,repeat_start_char:int,rejected_token_index:int,period:int,repeats:int,snippet:string>, source_dataset string, source_task string, source_eval_key string"
)
#: Speakers of the from/value form.
SPEAKERS = {"human": "user", "gpt": "assistant", "system": "system"}


def non_blank(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that hold more than white space."""
    return lines.filter(F.regexp_replace(value, r"(?U)\s", "") != "")


def checked_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines as ``value``; a line that is no JSON is an error when it is read."""
    whole = F.try_parse_json("value")
    return non_blank(lines).withColumn("value", F.when(whole.isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("value", 1, 80)))))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return checked_lines(spark.read.text(path))


def messages_of(field: Column) -> Column:
    """The chat messages in a field's JSON, null where it is a plain value."""
    first = F.get_json_object(field, "$[0]")
    roles = F.from_json(field, MESSAGES)
    said = F.from_json(field, "array<map<string,string>>")
    speaker = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    converted = F.transform(said, lambda m: F.struct(F.coalesce(F.try_element_at(speaker, F.try_element_at(m, F.lit("from"))), F.lit("user")).alias("role"), F.coalesce(F.try_element_at(m, F.lit("value")), F.lit("")).alias("content")))
    has = lambda key: F.array_contains(F.json_object_keys(first), key)
    return F.when(has("role"), roles).when(has("from"), converted)


def messages_in(v: Column, field: str) -> Column:
    """``messages_of`` a field of a parsed record: its first element tells the form."""
    path = f"$.{field}"
    speaker = F.create_map(*[F.lit(x) for kv in SPEAKERS.items() for x in kv])
    said = F.try_variant_get(v, path, "array<map<string,string>>")
    converted = F.transform(said, lambda m: F.struct(F.coalesce(F.try_element_at(speaker, F.try_element_at(m, F.lit("from"))), F.lit("user")).alias("role"), F.coalesce(F.try_element_at(m, F.lit("value")), F.lit("")).alias("content")))
    has = lambda key: F.try_variant_get(v, f"{path}[0].{key}", "variant").isNotNull()
    return F.when(has("role"), F.try_variant_get(v, path, MESSAGES)).when(has("from"), converted)


def prompts(lines: DataFrame, *, prompt_field: str = "conversations", source_field: str | None = "source", source_values: list[str] | None = None, skip: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """text, chat_messages and source of JSON lines; filters come before messages are taken apart, the limit last.

    A line is parsed once, into a VARIANT, from which fields of any form are taken; a malformed line is an error. The
    limit takes the first lines as they stand in the input; 0 and None are no limit.
    """
    rows = non_blank(lines).withColumn("__line", F.monotonically_increasing_id()) if limit else non_blank(lines)
    # an exploded array of one: filters on what is taken from the record stay above it, so it isn't parsed for them again
    rows = rows.select(*rows.columns, F.explode(F.array(F.parse_json("value"))).alias("__record"))
    record = F.col("__record")
    if source_field:
        there = F.try_variant_get(record, f"$.{source_field}", "variant").isNotNull()  # a JSON null is there
        source = F.when(there, F.coalesce(F.try_variant_get(record, f"$.{source_field}", "string"), F.lit("None"))).otherwise("")
    else:
        source = F.lit("")
    rows = rows.withColumn("source", source)
    if source_values:
        rows = rows.filter(F.col("source").isin(*source_values))
    rows = rows.filter(~holds_any("source", skip or []))
    there = F.try_variant_get(record, f"$.{prompt_field}", "variant").isNotNull()
    plain = F.when(there, F.coalesce(F.try_variant_get(record, f"$.{prompt_field}", "string"), F.lit("None"))).otherwise("")
    rows = rows.withColumn("chat_messages", messages_in(record, prompt_field))
    if limit:
        rows = rows.orderBy("__line").limit(limit)
    return rows.select(F.when(F.col("chat_messages").isNull(), plain).otherwise("").alias("text"), "chat_messages", "source")


def load_prompts(spark: SparkSession, *, input_jsonl: str | None = None, dataset_path: str | None = None, **options) -> DataFrame:
    """From JSON lines or, without them, from an exported dataset in Parquet."""
    if input_jsonl:
        return prompts(spark.read.text(str(input_jsonl)), **options)
    if dataset_path:
        rows = spark.read.parquet(str(dataset_path))
        return prompts(rows.select(F.to_json(F.struct("*")).alias("value")), **options)
    raise ValueError("input_jsonl or dataset_path must be given")


def format_prompt(text: Column, chat: Column, template: str) -> Column:
    """The text, or the chat as ``role: content`` lines, in the template's place."""
    lines = F.array_join(F.transform(chat, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")
    prompt = F.when(chat.isNotNull() & (F.size(chat) > 0), lines).otherwise(F.coalesce(text, F.lit("")))
    before, _, after = template.partition("{prompt}")
    return F.concat(F.lit(before), prompt, F.lit(after))


#: The parts of a completion response that are read.
RESPONSE = "choices array<struct<text:string,logprobs:struct<tokens:array<string>,top_logprobs:array<map<string,double>>>>>"


def parse_completions(rows: DataFrame, response: str = "response") -> DataFrame:
    """Adds completion, tokens and alternatives from the JSON of completion responses (first choice), and failed.

    A response is parsed once. Its alternatives keep their order, which a VARIANT's fields would not; empty and missing
    positions are left out. A response that is missing, malformed or no JSON object has failed; it stops nothing.
    """
    names = [c for c in rows.columns]
    parsed = F.from_json(F.col(response), f"{RESPONSE}, __malformed string", {"columnNameOfCorruptRecord": "__malformed"})
    rows = rows.withColumn("__parsed", parsed)
    broken = F.col("__parsed").isNull() | F.col("__parsed.__malformed").isNotNull() | F.startswith(F.ltrim(F.col(response)), F.lit("["))
    rows = rows.withColumn("failed", broken).withColumn("__choice", F.when(~F.col("failed"), F.get(F.col("__parsed.choices"), F.lit(0))))

    def options(m):
        return F.transform(F.map_entries(m), lambda e, k: F.struct(k.alias("ord"), e["key"].alias("tok"), e["value"].alias("lp")))

    none = F.array().cast("array<map<string,double>>")
    tops = F.coalesce(F.col("__choice.logprobs.top_logprobs"), none)
    every = F.transform(tops, lambda m, k: F.struct(k.alias("idx"), F.coalesce(options(m), F.array().cast("array<struct<ord:int,tok:string,lp:double>>")).alias("options")))
    has = F.col("__choice.logprobs").isNotNull()
    rows = rows.withColumn("completion", F.when(has, F.lit("")).otherwise(F.coalesce(F.col("__choice.text"), F.lit(""))))
    rows = rows.withColumn("tokens", F.coalesce(F.col("__choice.logprobs.tokens"), F.array().cast("array<string>")))
    rows = rows.withColumn("alternatives", F.filter(every, lambda a: (F.size(a["options"]) > 0) & (a["idx"] < F.size("tokens"))))
    return rows.select(*(F.col(f"`{c}`") for c in names if c not in ("failed", "completion", "tokens", "alternatives")), "failed", "completion", "tokens", "alternatives")


def pairs_of(lines: DataFrame) -> DataFrame:
    """Pairs of JSON lines, with null for fields that a line lacks; blank lines are left out."""
    return checked_lines(lines).select(F.from_json("value", PAIR, {"mode": "FAILFAST"}).alias("p")).select("p.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return pairs_of(spark.read.text(path))


def as_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON lines that keep null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
