"""Training samples from documents and conversations: export, filter, sample, template, validate, append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import after_thinking, answer_part, chat_text, context_prompt, digest, qfs_text, sampled, think_part
from ..sources.tables import successful

CHAT_SCHEMA = "conversations array<struct<role:string,content:string>>"


def export_texts(docs: DataFrame) -> DataFrame:
    """(filename, body) of each successful document."""
    return successful(docs).select(F.format_string("doc_%d.txt", "id").alias("filename"), F.concat(F.lit("Source URL: "), "url", F.lit("\n\n"), "content_text").alias("body"))


def write_texts(docs: DataFrame, path: str) -> None:
    """(filename, body) of all documents in packed Parquet files: no file system holds a file for each of 10^9 texts."""
    export_texts(docs).write.mode("overwrite").parquet(path)


def unpack_texts(packed: DataFrame, folder: str) -> DataFrame:
    """Write each (filename, body) to a file of its own in a folder that all executors share; (filename, bytes) of what was
    written. For exports that a file system can hold; lazy, as any DataFrame, and safe to repeat."""

    def run(batches):
        import os

        import pyarrow as pa

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(os.path.join(folder, os.path.basename(name)), "w", encoding="utf-8") as f:
                    sizes.append(f.write(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["filename", "characters"])

    return packed.select("filename", "body").mapInArrow(run, "filename string, characters bigint")


def long_enough(docs: DataFrame, least: int, text_col: str = "content_text") -> DataFrame:
    return docs.where(F.length(text_col) >= least)


def chat_rows(samples: DataFrame) -> DataFrame:
    """(sample_id, text) of the samples that have a system, a user and an assistant turn, in the chat template."""
    turn = lambda i: F.col("conversations")[i]["content"]
    whole = samples.where((F.size("conversations") >= 3) & turn(0).isNotNull() & turn(1).isNotNull() & turn(2).isNotNull())
    return whole.select("sample_id", chat_text(turn(0), turn(1), turn(2)).alias("text"))


def chat_to_qfs(samples: DataFrame) -> DataFrame:
    """The user turn as input and the assistant turn after its reasoning as output, in the summary template."""
    turn = lambda i: F.col("conversations")[i]["content"]
    whole = samples.where((F.size("conversations") >= 3) & turn(1).isNotNull() & turn(2).isNotNull())
    return whole.select("sample_id", qfs_text(turn(1), after_thinking(turn(2))).alias("text"))


def think_split(samples: DataFrame) -> DataFrame:
    """(sample_id, thought, answer) of each assistant turn."""
    said = samples.select("sample_id", F.explode(F.filter("conversations", lambda t: t["role"] == "assistant")).alias("turn"))
    return said.select("sample_id", think_part(F.col("turn.content")).alias("thought"), answer_part(F.col("turn.content")).alias("answer"))


def qfs_rows(samples: DataFrame) -> DataFrame:
    """Distinct QFS samples with an output, in the template."""
    kept = samples.where("input is not null and length(trim(output)) > 0").groupBy("instruction", "input", "output").agg(F.min("sample_id").alias("sample_id"))
    return kept.select("sample_id", qfs_text(F.concat_ws("\n", "instruction", "input"), F.col("output")).alias("text"))


# Fixed value: the reasoning of an answer that came without any.
NO_THOUGHT = "<think>Answer generated based on context.</think>"


def parse_answers(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """JSON answers that have a question and a final response, with the assistant turn made of them: the reasoning under
    `thought_process`, or a default, and the response on the next line. Anything else is left out."""
    parsed = raw.withColumn("_a", F.from_json(text_col, "thought_process string, question string, final_response string"))
    kept = parsed.where(F.col("_a.question").isNotNull() & F.col("_a.final_response").isNotNull())
    thought = F.coalesce("_a.thought_process", F.lit(NO_THOUGHT))
    return kept.select(*[c for c in raw.columns if c != text_col], F.col("_a.question").alias("question"), thought.alias("thought"), F.col("_a.final_response").alias("final_response"), F.concat(thought, F.lit("\n"), "_a.final_response").alias("assistant"))


def conversations(answers: DataFrame, system: str, context_col: str = "context", limit: int = 3000) -> DataFrame:
    """The answers of parse_answers with `conversations`: system, context and question, and answer."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return answers.withColumn("conversations", F.array(turn("system", F.lit(system)), turn("user", context_prompt(F.col(context_col), F.col("question"), limit)), turn("assistant", F.col("assistant"))))


def negatives(docs: DataFrame, questions: list[str], refusal: str, percent: int = 15, seed: int = 0) -> DataFrame:
    """Samples with a question that has nothing to do with the document, for a fixed share of the documents."""
    pick = F.array(*map(F.lit, questions))[F.pmod(digest(F.col("id"), seed + 1), F.lit(len(questions))).cast("int")]
    rows = successful(docs).where((F.length("content_text") >= 50) & sampled(F.col("id"), percent, seed))
    return rows.select(F.col("id").alias("doc_id"), context_prompt(F.col("content_text"), pick, 1000).alias("user"), F.lit(refusal).alias("assistant"))


def append_json_lines(spark: SparkSession, samples: DataFrame, path: str, key: str = "doc_id") -> int:
    """Append the samples whose key the sink doesn't have yet; the number of appended rows. A run that was cut short goes on
    where it ended, in whatever order its input comes."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    fresh = samples.join(spark.read.schema(samples.schema).json(path).select(key).distinct(), key, "left_anti") if there else samples
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n
