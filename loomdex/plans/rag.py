"""Answers from retrieved excerpts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.display import citations, context, highlight, highlight_terms, one_decimal, progress, timestamp, typo_notice, wants_highlight, STOPWORDS
from loomdex.plans.engine import HybridEngine
from loomdex.plans.intent import analyze
from loomdex.sources.remote import PermanentError, TransientError

LOG = logging.getLogger(__name__)
SYSTEM_PROMPT = """You answer questions about recorded talks.
1. Use nothing but the numbered excerpts of the message.
2. Put the number of the excerpt in brackets after each statement it supports, as in [2].
3. Where the excerpts do not answer the question, say so.
4. Keep to what the speakers mean; do not correct or extend it.
5. Invent neither quotations nor sources.
6. If a question can be read in several ways, say which way you take it.
7. Write calmly and plainly."""
NO_RESULTS = "No relevant excerpts were found for this question."


def user_prompt(query: str, context_text: str) -> str:
    return f"Question: {query}\n\nNumbered transcript excerpts:\n\n{context_text}\n\nAnswer the question from these excerpts only and cite them by number."


@dataclass(frozen=True)
class Answer:
    query: str
    answer: str | None
    citations: list[dict] = field(default_factory=list)
    model: str | None = None

    @property
    def num_sources(self) -> int:
        return len(self.citations)


@dataclass
class RagPipeline:
    engine: HybridEngine
    generate: Callable[..., str]
    top_k: int = 5

    def answer(self, query: str, top_k: int | None = None, **options) -> Answer:
        """Without results the model is not asked."""
        found = self.engine.search(query, top_k or self.top_k).cache()
        try:
            cited = [r.asDict() for r in citations(found).orderBy("number").collect()]  # top_k rows
            if not cited:
                return Answer(query, NO_RESULTS)
            text = context(found).first()["context"]
        finally:
            found.unpersist()
        return Answer(query, self.generate(SYSTEM_PROMPT, user_prompt(query, text), **options), cited, options.get("model"))


def render(results: DataFrame, query: str) -> DataFrame:
    """Rows to show: number, title, relevance, timestamp, progress, body with highlights."""
    ask = analyze(query, STOPWORDS)
    terms = highlight_terms(ask.exact_phrases, ask.meaningful_words) if wants_highlight(ask.exact_phrases, ask.is_question, query) else []
    return results.select(
        (F.col("rank") + 1).alias("number"), "title", F.concat(one_decimal(F.col("percentage_score")), F.lit("%")).alias("relevance"),
        timestamp(F.col("start_char")).alias("timestamp"), progress(F.col("start_char"), F.col("video_length_chars")).alias("progress"),
        highlight(F.col("text"), terms).alias("body"),
    )


def respond(engine: HybridEngine, query: str, generate: Callable[..., str], k: int = 4) -> tuple[str, DataFrame, str | None]:
    """Spelling notice, rows to show, and the answer; a failing model leaves the rows and no answer."""
    notice = typo_notice(engine.check_query_terms(query))
    found = engine.search(query, k).cache()
    text = context(found).first()["context"]
    try:
        answer = generate(SYSTEM_PROMPT, user_prompt(query, text))
    except (TransientError, PermanentError, OSError) as e:  # the model's failures; those of retrieval are raised
        LOG.warning("no answer to %r: %s", query, e)
        answer = None
    return notice, render(found, query), answer


def prompt_grid(spark: SparkSession, prompts: list[str], models: list[str]) -> DataFrame:
    """(prompt_no, prompt, model_no, model): every prompt with every model; both lists are short."""
    p = spark.createDataFrame(list(enumerate(prompts)), "prompt_no int, prompt string")
    return p.withColumn("m", F.explode(F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(m).alias("model")) for i, m in enumerate(models)]))).select("prompt_no", "prompt", "m.*")


def compare(pipeline: RagPipeline, prompts: list[str], models: list[str]) -> str:
    """Markdown report of all answers; a failing cell holds its error."""
    lines = ["# Comparison"]
    for r in prompt_grid(pipeline.engine.chunks.sparkSession, prompts, models).orderBy("prompt_no", "model_no").collect():
        if r["model_no"] == 0:
            lines.append(f"\n## {r['prompt']}")
        try:
            got = pipeline.answer(r["prompt"], model=r["model"])
            sources = [f"- [{c['number']}] {c['title']} ({c['timestamp']}, {c['percentage_score']:.1f}%)" for c in got.citations]
            lines.append(f"\n### {r['model']}\n\n{got.answer}\n\n" + ("\n".join(sources) or "_(No sources retrieved)_"))
        except Exception as e:
            lines.append(f"\n### {r['model']}\n\n**Failed:** {type(e).__name__}: {e}")
    return "\n".join(lines) + "\n"
