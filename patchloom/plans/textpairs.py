"""Text pairs of pull requests and commits, and the inputs of batch scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import text
from patchloom.functions.paths import recode
from patchloom.operators import sampling
from patchloom.operators.textjoin import MAX_CHARS, join_texts

# Labels of the three groups.
GROUPS = {0: "HPR", 1: "APR", 2: "Benchmark"}


def commit_messages(details: DataFrame, tag: int) -> DataFrame:
    """Distinct (sha, pr_id, message) of rows with a patch."""
    rows = details.where(F.col("patch").isNotNull()).select("sha", "pr_id", "message")
    return rows.distinct().withColumn("is_agent", F.lit(tag))


def pr_descriptions(pr: DataFrame, human_pr: DataFrame) -> DataFrame:
    def side(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("id").alias("pr_id"),
            text.description(F.col("title"), F.col("body")).alias("pr_description"),
            F.col("merged_at").alias("pr_merged_at"),
        )

    return side(pr).unionByName(side(human_pr))


def commit_descriptions(
    details: DataFrame, human_details: DataFrame, pr: DataFrame, human_pr: DataFrame
) -> DataFrame:
    """Commits of merged pull requests that have a message and a description."""
    commits = commit_messages(details, 1).unionByName(commit_messages(human_details, 0))
    usable = pr_descriptions(pr, human_pr).where(
        F.col("pr_description").isNotNull() & F.col("pr_merged_at").isNotNull()
    )
    return commits.where(F.col("message").isNotNull()).join(usable, on="pr_id", how="inner")


def pr_text_pairs(
    details: DataFrame,
    human_details: DataFrame,
    pr: DataFrame,
    human_pr: DataFrame,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """Per pull request and chunk of its commits: the messages, and the description once per commit.

    The description is a constant of the pull request, so it is joined after the messages
    were put together and repeated in place instead of travelling with every commit. Only its
    length goes along, so that chunks bound the repeated descriptions as well.
    """
    commits = commit_messages(details, 1).unionByName(commit_messages(human_details, 0))
    usable = pr_descriptions(pr, human_pr).where(
        F.col("pr_description").isNotNull() & F.col("pr_merged_at").isNotNull()
    )
    lengths = usable.groupBy("pr_id").agg(F.max(F.length("pr_description") + 1).cast("long").alias("_length"))
    kept = commits.where(F.col("message").isNotNull()).join(lengths, on="pr_id", how="inner")
    joined = join_texts(
        kept, ["pr_id", "is_agent"], {"message": "message"}, ["sha"], " ", max_chars, weight=F.col("_length")
    )
    again = (F.col("rows") - 1).cast("int")
    repeated = F.concat(F.repeat(F.concat("pr_description", F.lit(" ")), again), F.col("pr_description"))
    rows = joined.join(usable.drop("pr_merged_at"), on="pr_id", how="inner")
    return rows.select("pr_id", "is_agent", "part", "message", repeated.alias("pr_description"))


def group_label(group: Column) -> Column:
    return recode(group, GROUPS)


def _patched(details: DataFrame, columns: list[str], tag: int) -> DataFrame:
    return details.where(F.col("patch").isNotNull()).select(*columns).distinct().withColumn("is_agent", F.lit(tag))


def _corpus(corpus: DataFrame, columns: list[str]) -> DataFrame:
    named = corpus.select(F.col("hash").alias("sha"), "message", F.col("diff").alias("patch"))
    return named.select(*columns)


def corpus_rows(corpus: DataFrame, columns: list[str]) -> DataFrame:
    return _corpus(corpus, columns).distinct().withColumn("is_agent", F.lit(2))


def patches_for_generation(
    details: DataFrame,
    human_details: DataFrame,
    corpus: DataFrame,
    fraction: float = 0.05,
    seed: int = 42,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """A share of the file rows of each group and the whole corpus, patches joined per commit."""
    cols, key = ["sha", "patch"], ["sha", "patch"]
    sampled = [
        sampling.sample_fraction(_patched(d, cols, tag), fraction, key, seed=seed)
        for d, tag in ((details, 1), (human_details, 0))
    ]
    # Whole texts of the corpus are shuffled once: repeated rows are dropped where the texts of a commit are joined.
    rows = sampled[0].unionByName(sampled[1]).unionByName(_corpus(corpus, cols).withColumn("is_agent", F.lit(2)))
    return join_texts(rows, ["sha", "is_agent"], {"patch": "patch"}, ["patch"], "\n", max_chars, distinct=True).drop("rows")


def fully_patched(details: DataFrame) -> DataFrame:
    """Rows of commits without any file that lacks a patch."""
    broken = details.where(F.col("patch").isNull()).select("sha").distinct()
    return details.join(broken, on="sha", how="left_anti")


def patches_for_judging(
    details: DataFrame,
    human_details: DataFrame,
    corpus: DataFrame,
    rows_per_group: int = 1500,
    seed: int = 42,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """A fixed number of file rows per group from fully patched commits, patches joined per commit."""
    cols = ["sha", "message", "patch"]
    parts = [
        sampling.sample_n(_patched(fully_patched(d), cols, tag), rows_per_group, cols, seed)
        for d, tag in ((details, 1), (human_details, 0))
    ]
    picked = sampling.sample_n(corpus.select("hash", "message", "diff"), rows_per_group, ["hash"], seed)
    rows = parts[0].unionByName(parts[1]).unionByName(corpus_rows(picked, cols))
    return join_texts(rows, ["sha", "is_agent", "message"], {"patch": "patch"}, ["patch"], "\n", max_chars).drop("rows")


def true_messages(details: DataFrame, human_details: DataFrame, corpus: DataFrame) -> DataFrame:
    """(sha, is_agent, label_message): what the author wrote."""
    cols = ["sha", "message"]
    rows = _patched(details, cols, 1).unionByName(_patched(human_details, cols, 0))
    return rows.unionByName(corpus_rows(corpus, cols)).withColumnRenamed("message", "label_message")


def attach_true_messages(generated: DataFrame, labels: DataFrame) -> DataFrame:
    return generated.join(labels, on=["sha", "is_agent"], how="left")


def message_lengths(details: DataFrame) -> DataFrame:
    """Distinct commit messages of pull requests with their length."""
    rows = details.select("pr_id", "sha", "message").distinct()
    return rows.withColumn("commit_message_len", text.char_count(F.col("message")))
