"""One object with the operations that users call: ask, search, calculate, chart, list the schema."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions import catalog
from tallyspark.functions.calculator import CalculationError, compile_expression
from tallyspark.operators import retrieval
from tallyspark.plans import presentation
from tallyspark.plans.agent import Agent
from tallyspark.plans.dsl import QueryError, Store, compiled, json_rows, normal_code, split, units_of
from tallyspark.plans.questions import ASK, Company, Memory, Slots, parse_with, step, to_query

TOOL_LIMITS = (1, 200)
#: Pieces of evidence and their characters.
EVIDENCE, EVIDENCE_CHARS = 5, 160


def compact(found: list[dict], text: str = "text") -> list[dict]:
    """The first pieces of evidence, their texts on one line and cut."""
    return [{k: presentation.short(" ".join(v.split()), EVIDENCE_CHARS) if k == text and v else v for k, v in row.items()} for row in found[:EVIDENCE]]


@dataclass
class Engine:
    """``ask`` is an optional language model (question to JSON text); without one the rules parse."""

    spark: SparkSession
    store: Store
    companies: list[Company]
    chunks: DataFrame | None = None
    model: Callable[[str], str | None] | None = None
    this_year: int = field(default_factory=lambda: datetime.date.today().year)
    sessions: dict[str, Memory] = field(default_factory=dict)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def schema_tables(self) -> DataFrame:
        return catalog.fields_table(self.spark)

    def intent(self, question: str, session: str | None = None) -> Slots:
        slots = parse_with(self.model, question, self.companies, self.this_year)
        if session is None:
            return slots
        self.sessions[session], slots = step(self.sessions.get(session, Memory()), slots)
        return slots

    def query(self, question: str, session: str | None = None) -> dict:
        """Rows, units, answer and chart of a question, or what must be asked back; errors are told, not raised."""
        slots = self.intent(question, session)
        if slots.missing:
            return {"status": "clarification", "slot": slots.missing, "question": ASK[slots.missing]}
        results = []
        try:
            for q in split(to_query(slots), self.store):
                df = compiled(q, self.store)
                units = units_of(q, self.store)
                entry = {"rows": json_rows(df), "units": units, "answer": presentation.answer(df, units)}
                if slots.chart:
                    metric = self.store.locate(q.metrics[0])[1]
                    entry["chart"] = presentation.chart(df, metric, slots.chart)
                results.append(entry)
        except QueryError as e:
            return {"status": "error", "error": str(e)}
        filled = any(r["rows"] for r in results)
        return {"status": "ok_nonempty" if filled else "ok_empty", "results": results, "warnings": list(slots.warnings)}

    def tool_query(self, metrics: list[str], years: list[int], periods: list[str], companies: list[str] | None = None, limit: int = 20) -> dict:
        """The narrower form for an agent: up to four metrics, known companies only, years and periods given; without companies a ranking."""
        known = {c.stock_code for c in self.companies}
        codes = [normal_code(c) for c in companies or []]
        if unknown := [c for c in codes if c not in known]:
            return {"error": f"unknown companies: {', '.join(unknown)}"}
        if not metrics or not years or not periods:
            return {"error": "metrics, years and periods are needed"}
        slots = Slots(intent="metric_query" if codes else "ranking_query", metrics=tuple(metrics[:4]), codes=tuple(codes), years=tuple(years), periods=tuple(periods), limit=max(TOOL_LIMITS[0], min(TOOL_LIMITS[1], limit)))
        try:
            return {"results": [json_rows(compiled(q, self.store)) for q in split(to_query(slots), self.store)]}
        except QueryError as e:
            return {"error": str(e)}

    def search(self, question: str, top_k: int = 5, per_document: int = 2, condition=None) -> list[dict]:
        """Best chunks for a question; ``condition`` is a filter on the chunks' metadata."""
        if self.chunks is None:
            return []
        asked = self.spark.createDataFrame([(0, question)], "qid int, question string")
        found = retrieval.hybrid(self.chunks, asked, max(1, min(10, top_k)), per_document, condition=condition)
        return [r.asDict() for r in found.orderBy("rank").collect()]

    def calculate(self, expression: str, variables: dict[str, float | list[float]] | None = None) -> dict:
        from pyspark.sql import functions as F

        def column(v):
            return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, (list, tuple)) else F.lit(float(v))

        try:
            made = compile_expression(expression, {k: column(v) for k, v in (variables or {}).items()})
            return {"result": self.spark.range(1).select(made.alias("x")).first()["x"]}
        except CalculationError as e:
            return {"error": str(e)}
        except Exception as e:  # noqa: BLE001  a failing expression, such as a division by zero, is an answer too
            return {"error": str(e).splitlines()[0]}

    def analysis(self, question: str, session: str | None = None) -> dict:
        """Figures and evidence for one question: the query's answer, then the best chunks, company filter first."""
        figures = self.query(question, session)
        codes = [c.stock_code for c in self.companies if c.stock_abbr and c.stock_abbr in question]
        evidence: list[dict] = []
        if self.chunks is not None:
            from pyspark.sql import functions as F

            if codes and "stock_code" in self.chunks.columns:
                evidence = self.search(question, condition=F.col("stock_code").isin(*codes))
            evidence = evidence or self.search(question)
        return {"route": self.route(question), "figures": figures, "evidence": compact(evidence)}

    def route(self, question: str) -> str:
        """Whether a question is answered by figures, first needs a slot, or asks for texts alone."""
        slots = self.intent(question)
        if not slots.metrics and not (slots.codes and slots.years):
            return "texts"
        return "clarification" if slots.missing else "figures"

    def tools(self) -> dict[str, Callable]:
        return {"query_financial_data": self.tool_query, "search_research_reports": self.search, "calculate": self.calculate}

    def agent(self, decide: Callable, summarise: Callable) -> Agent:
        """An agent over the engine's tools; where no decision comes, the question's own answer does."""

        def otherwise(question: str) -> str:
            figures = self.query(question)
            answers = [r["answer"] for r in figures.get("results", ())]
            return "\n".join(answers) or figures.get("question") or figures.get("error") or ""

        return Agent(self.tools(), decide, summarise, otherwise)

    def run_tools(self, plan: list[tuple[str, dict]], most: int = 8) -> list[dict]:
        """Runs up to ``most`` tool calls in turn and returns their trace; an unknown or failing tool is an entry with its error."""
        runner = Agent(self.tools(), lambda _: None, lambda _: None)
        return [runner.use(n, name, arguments) for n, (name, arguments) in enumerate(plan[:most], 1)]

    def with_model(self, model: Callable[[str], str | None] | None) -> Engine:
        return replace(self, model=model)
