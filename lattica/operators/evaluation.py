"""Scoring of answers: correctness, medians, costs, failures, votes, verdicts and checks of question sets."""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import price_key
from lattica.sources.files import SUPPORTED


def correctness(choice: Column, key: Column) -> Column:
    """1 for the right option, trimmed and in lower case, else 0; a null choice is wrong."""
    return F.coalesce((F.lower(F.trim(choice)) == F.lower(F.trim(key))).cast("int"), F.lit(0))


def aggregate_columns(rows: DataFrame) -> DataFrame:
    """Per strategy: response_count, accuracy, quality_median, tokens_median, tokens_p95, latency_median, cost.

    rows: strategy, question_id, correct, quality, tokens, latency, price. First each question's mean correctness, low
    median of quality (0 where all are null) and medians, then the strategy's mean and medians of these; the 95th
    percentile is the nearest rank over all rows.
    """
    by_question = rows.groupBy("strategy", "question_id").agg(
        F.avg("correct").alias("correct"),
        F.coalesce(F.expr("percentile_disc(0.5) within group (order by quality)"), F.lit(0)).alias("quality"),
        F.median("tokens").alias("tokens"),
        F.median("latency").alias("latency"),
    )
    medians = by_question.groupBy("strategy").agg(
        F.round(F.avg("correct"), 6).alias("accuracy"),
        F.round(F.median("quality"), 6).alias("quality_median"),
        F.round(F.median("tokens"), 6).alias("tokens_median"),
        F.round(F.median("latency"), 6).alias("latency_median"),
    )
    raw = rows.groupBy("strategy").agg(F.count("*").alias("response_count"), F.round(F.sum("price"), 6).alias("cost"))
    return medians.join(raw.join(nearest_rank(rows, "tokens", 0.95, "tokens_p95"), "strategy", "left"), "strategy")


def nearest_rank(rows: DataFrame, column: str, share: float, name: str, by: str = "strategy") -> DataFrame:
    """by, name: the least value that the given share of rows doesn't exceed; nulls aside. Counts by value come first, so no task holds all rows."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy(column)
    ranked = counted.select(by, column, F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy(by)).alias("all"))
    return ranked.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(by).agg(F.min(column).alias(name))


def price(tokens_in: Column, tokens_out: Column, embedding: Column, in_price: Column, out_price: Column) -> Column:
    """Dollars at prices per million tokens; an unknown price is 0."""
    zero = F.lit(0.0)
    return ((tokens_in + F.coalesce(embedding, F.lit(0))) * F.coalesce(in_price, zero) + tokens_out * F.coalesce(out_price, zero)) / 1e6


def failure(correct: Column, parse_error: Column, choice_text: Column, marker: str = "insufficient information") -> Column:
    return F.when(correct == 1, None).when(parse_error.isNotNull(), "parse_error").when(F.lower(choice_text).startswith(marker), "unknown_choice").otherwise("wrong_choice")


def majority(rows: DataFrame) -> DataFrame:
    """strategy, question_id, choice: the commonest choice, of equally common ones the first seen (by seq)."""
    counted = rows.groupBy("strategy", "question_id", "choice").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.groupBy("strategy", "question_id").agg(F.min(F.struct(-F.col("n"), "first", "choice")).getField("choice").alias("choice"))


def error_sets(wrong: DataFrame, a: str, b: str) -> DataFrame:
    """part, n: questions that only a, only b, or both get wrong. wrong: strategy, question_id."""
    one, two = (wrong.filter(F.col("strategy") == s).select("question_id").distinct() for s in (a, b))
    parts = [("only_a", one.subtract(two)), ("only_b", two.subtract(one)), ("both", one.intersect(two)), ("either", one.union(two).distinct())]
    out = None
    for name, df in parts:
        counted = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def with_overrides(rows: DataFrame, overrides: DataFrame, key: list[str]) -> DataFrame:
    """rows with the last override of each key (by line) in place of its quality, where that is not null."""
    last = overrides.groupBy(*key).agg(F.max_by("human_quality", "line").alias("human_quality"))
    return rows.join(last, key, "left").withColumn("quality", F.coalesce("human_quality", "quality")).drop("human_quality")


def spot_checks(rows: DataFrame) -> DataFrame:
    """strategy, question_id, run, triggers of answers to look at: right without reasoning, or unfaithful."""
    triggers = F.concat_ws("+", F.when((F.col("correct") == 1) & (F.col("quality") == 0), "lucky_correct"), F.when(F.col("faithful") == 0, "hallucination_suspect"))
    return rows.select("strategy", "question_id", "run", triggers.alias("triggers")).filter("triggers <> ''")


def pareto(metrics: DataFrame, full: str, rag: str, graph: str) -> DataFrame:
    """One row: accuracy_ok, tokens_ok, latency_ok, passed of the graph strategy against the other two."""
    pick = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    eps = 1e-9
    row = metrics.agg(
        (pick(graph, "accuracy") + eps >= pick(full, "accuracy")).alias("accuracy_ok"),
        (pick(graph, "tokens_median") <= pick(rag, "tokens_median") + eps).alias("tokens_ok"),
        (pick(graph, "latency_median") <= pick(rag, "latency_median") + eps).alias("latency_ok"),
    )
    return row.withColumn("passed", F.col("accuracy_ok") & F.col("tokens_ok") & F.col("latency_ok"))


def skewed(rows: DataFrame, column: str, most: float = 0.6) -> DataFrame:
    """Values of a column, their share, and whether it is above `most`."""
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    share = F.round(F.col("n") / F.col("total"), 6)
    return counted.join(F.broadcast(total)).select(column, "n", share.alias("share"), (share > most).alias("skewed"))


#: Kinds of questions, ways to fail that a wrong option may test, and what an option that admits to know too little says.
PATTERNS = ["multi_hop", "cross_source", "synonym_alias", "single_doc"]
UNSURE = ["정보 부족", "알 수 없음"]
UNSURE_MODE = "retrieval_failure"


def schema_faults(questions: DataFrame) -> DataFrame:
    """id, rule, at: what is wrong with the form of questions (missing fields, patterns, lengths, numbers, options)."""
    short = lambda c, lo, hi: F.when(F.col(c).isNotNull() & ~F.length(c).between(lo, hi), F.struct(F.lit(f"{c}_length").alias("rule"), F.lit(c).alias("at")))
    fault = lambda when, rule, at: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(at).alias("at")))
    n, option = F.size("options"), F.col("options")
    checks = [
        *[fault(F.col(c).isNull(), "missing", c) for c in ("id", "question", "options", "reference_reasoning")],
        fault(~F.col("id").rlike("^Q[0-9]{2,3}$"), "id_shape", "id"),
        short("question", 5, 500),
        short("reference_reasoning", 20, 2000),
        fault(~F.col("domain_pattern").isin(PATTERNS), "domain_pattern", "domain_pattern"),
        fault(~F.col("hops_required").between(1, 6), "hops_required", "hops_required"),
        fault(option.isNotNull() & ~n.between(4, 5), "option_count", "options"),
        fault(F.exists(option, lambda o: o["id"].isNull() | o["text"].isNull() | o["is_correct"].isNull()), "missing", "options[]"),
        fault(F.exists(option, lambda o: ~o["id"].rlike("^[a-e]$")), "option_id", "options[].id"),
        fault(F.exists(option, lambda o: ~F.length(o["text"]).between(1, 300)), "option_text", "options[].text"),
    ]
    return questions.select("id", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("id", "f.rule", "f.at")


def meta_faults(meta: dict) -> list[tuple[str, str]]:
    """(field, what is wrong) of a dataset's description: three names are needed, counts are not negative, others are free."""
    out = [(c, "missing" if meta.get(c) is None else "no text") for c in ("dataset_id", "domain", "language") if not isinstance(meta.get(c), str)]
    for part, names in (("corpus", ("file_count", "total_tokens_estimate")), ("questions", ("count",))):
        held = meta.get(part)
        if held is not None and not isinstance(held, dict):
            out.append((part, "no object"))
            continue
        out += [(f"{part}.{c}", "no count") for c in names if (held or {}).get(c) is not None and not (isinstance(held[c], int) and held[c] >= 0)]
    return out


def lint_questions(questions: DataFrame, sources: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """level, rule, id of faults in a question set; sources: path of the corpus's files.

    hard: no or several right options, no option that admits to know too little, a way to fail that is not in modes,
    sources that are absolute or don't exist (with or without the corpus's folder before them). warn: reasoning shorter
    than 50 or longer than 500 characters, one pattern of more than 60 % of the questions (without an id), and files of
    types that can't be ingested (their path as id; hidden ones aside).
    """
    right = F.size(F.filter("options", lambda o: o["is_correct"]))
    n = F.length("reference_reasoning")
    has = {f.name for f in questions.schema["options"].dataType.elementType.fields}
    rule = lambda when, level, name: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule")))
    checks = [rule(right == 0, "hard", "no_correct_answer"), rule(right > 1, "hard", "multiple_correct_answers"), rule(n < 50, "warn", "reference_too_short"), rule(n > 500, "warn", "reference_too_long")]
    if "failure_mode_tested" in has:
        unsure = lambda o: (o["failure_mode_tested"] == UNSURE_MODE) & (o["text"].contains(UNSURE[0]) | o["text"].contains(UNSURE[1]))
        checks.append(rule(~F.coalesce(F.exists("options", unsure), F.lit(False)), "hard", "missing_info_insufficient_option"))
        if modes is not None:
            checks.append(rule(F.exists("options", lambda o: o["failure_mode_tested"].isNotNull() & ~o["failure_mode_tested"].isin(modes)), "hard", "unknown_failure_mode"))
    own = questions.select("id", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("f.level", "f.rule", "id")
    named = questions.select("id", F.explode("expected_sources").alias("path")).withColumn("short", F.regexp_replace("path", "^[^/]+/", ""))
    absolute = named.filter("path like '/%'").select(F.lit("hard").alias("level"), F.lit("expected_source_absolute_path").alias("rule"), "id").distinct()
    there = sources.select("path").distinct()
    lost = named.filter("path not like '/%'").join(there, "path", "left_anti").join(there.withColumnRenamed("path", "short"), "short", "left_anti").select(F.lit("hard").alias("level"), F.lit("expected_source_missing").alias("rule"), "id").distinct()
    out = own.unionByName(absolute).unionByName(lost)
    if "domain_pattern" in questions.columns:
        patterns = skewed(questions.filter("domain_pattern is not null"), "domain_pattern").filter("skewed")
        out = out.unionByName(patterns.select(F.lit("warn").alias("level"), F.lit("domain_pattern_skewed").alias("rule"), F.lit(None).cast("string").alias("id")))
    name = F.substring_index("path", "/", -1)
    odd = there.filter(~name.startswith(".") & ~F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(SUPPORTED))
    return out.unionByName(odd.select(F.lit("warn").alias("level"), F.lit("unsupported_corpus_file").alias("rule"), F.col("path").alias("id")))


def lint(schema: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings in order: a set of wrong form is not judged further, but for its files, which are looked at in any case."""
    broken = not schema.isEmpty()
    form = schema.select(F.lit("hard").alias("level"), F.concat(F.lit("schema_violation:"), "rule").alias("rule"), "id")
    return form.unionByName(rules.filter("rule = 'unsupported_corpus_file'") if broken else rules)


#: Estimated tokens of what an extractor reads and writes for each PDF page and image, and writes for each chunk of text.
PDF_PAGE_TOKENS, IMAGE_TOKENS, OUTPUT_TOKENS = 800, 1500, 200


def dry_run_units(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """tokens, one row for each call of an extractor: the chunks (tokens) of texts, a page for each PDF, and each image.

    How many pages a PDF has is not looked up: one is the least. Hidden files and other types are no calls.
    """
    seen = files.filter(~F.substring_index("path", "/", -1).startswith("."))
    tokens = F.when(F.col("ext") == "pdf", PDF_PAGE_TOKENS).when(F.col("ext").isin("jpg", "jpeg", "png", "webp"), IMAGE_TOKENS).cast("bigint")
    return chunks.select(F.col("tokens").cast("bigint").alias("tokens")).unionByName(seen.select(tokens.alias("tokens")).filter("tokens is not null"))


def priced(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """rows with in_price and out_price of their model: by its name, else by that with the default vendor; null if unknown."""
    table = F.broadcast(prices)
    first = table.select(F.col("model").alias(model), F.col("input").alias("i1"), F.col("output").alias("o1"))
    second = table.select(F.col("model").alias("_key"), F.col("input").alias("i2"), F.col("output").alias("o2"))
    both = rows.join(first, model, "left").withColumn("_key", price_key(F.col(model))).join(second, "_key", "left")
    return both.select(*rows.columns, F.coalesce("i1", "i2").alias("in_price"), F.coalesce("o1", "o2").alias("out_price"))


def amortised(setup_tokens: int, questions: int) -> int:
    """Tokens of a setup that each question bears."""
    return setup_tokens // max(questions, 1)


def dry_run_cost(units: DataFrame, prices: DataFrame, *, output_tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """model, units, tokens, usd: what extraction of all units (tokens) would cost with each model of prices."""
    total = units.agg(F.count("*").alias("units"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    usd = (F.col("tokens") * F.col("input") + F.col("units") * output_tokens * F.col("output")) / 1e6
    return prices.crossJoin(F.broadcast(total)).select("model", "units", "tokens", F.round(usd, 6).alias("usd"))


#: Scores that a judge may give, and how often it is asked.
QUALITY_SCORES, FAITHFULNESS_SCORES, JUDGE_ATTEMPTS = (0, 1, 2), (0, 1), 2


def judge(call, question: str, valid: tuple[int, ...] = QUALITY_SCORES) -> dict:
    """score, rationale, error, retried of a judge, which is asked again once if its answer is no score of valid.

    call(question) gives {score, rationale}; a score has to be a whole number.
    """
    error, said = None, None
    for attempt in range(JUDGE_ATTEMPTS):
        try:
            said, error = call(question), None
        except Exception as e:  # noqa: BLE001
            said, error = None, f"{type(e).__name__}: {e}"
        if error is None:
            score = said.get("score") if isinstance(said, dict) else None
            if not isinstance(said, dict):
                error = "the answer is no object"
            elif not isinstance(score, int) or isinstance(score, bool):
                error = "the score is no whole number"
            elif score not in valid:
                error = f"score {score} is not in {valid}"
            else:
                return {"score": score, "rationale": str(said.get("rationale") or ""), "error": None, "retried": attempt > 0}
    return {"score": None, "rationale": str(said.get("rationale") or "") if isinstance(said, dict) else "", "error": error, "retried": True}


def judge_inputs(responses: DataFrame, shape: str) -> DataFrame:
    """question_id, run_index, reasoning, context of stored answers (body) for a judge; the context is empty unless it was stored."""
    at = "$.answer_generation.parsed.reasoning" if shape == "graph" else "$.parsed.reasoning"
    of = lambda path: F.coalesce(F.get_json_object("body", path), F.lit(""))
    return responses.select(of("$.question_id").alias("question_id"), F.get_json_object("body", "$.run_index").cast("int").alias("run_index"), of(at).alias("reasoning"), of("$.context").alias("context"))


def unanswered(wanted: DataFrame, responses: DataFrame) -> DataFrame:
    """Questions and runs (question_id, run_index) without a stored answer, for a run that is taken up again."""
    key = ["question_id", "run_index"]
    return wanted.join(responses.select(*key).distinct(), key, "left_anti")


REPORT = ["response_count", "accuracy", "tokens_median", "latency_median", "tokens_p95", "quality_median", "cost"]


def report(metrics: DataFrame, failures: DataFrame, roles: dict[str, str], *, title: str = "Report", questions: int = 0, runs: int = 0, overrides: int = 0) -> str:
    """A run's report in Markdown: metrics of each strategy, the verdict, and ways to fail.

    metrics: of aggregate_columns; failures: strategy, failure, n; roles: the strategies that are full, rag and graph. A
    strategy without answers has dashes; without all three there is no verdict.
    """
    held = {r["strategy"]: r.asDict() for r in metrics.filter(F.col("strategy").isin([*roles.values()])).collect()}
    lost = {(r["strategy"], r["failure"]): r["n"] for r in failures.collect()}
    number = lambda x: f"{x:,.0f}" if x >= 1000 else f"{x:.1f}"
    shown = {"response_count": lambda x: str(x), "accuracy": lambda x: f"{x * 100:.1f}%", "cost": lambda x: f"${x:.4f}" if x else "0"}
    lines = [f"# {title}", "", f"Questions: {questions} | Runs: {runs} | Overrides: {overrides}", "", "## Metrics", "", "| strategy | " + " | ".join(REPORT) + " |", "|---" * (len(REPORT) + 1) + "|"]
    for role, s in roles.items():
        row = held.get(s)
        lines.append(f"| {s} ({role}) | " + " | ".join(shown.get(c, number)(row[c]) if row and row[c] is not None else "-" for c in REPORT) + " |")
    lines += ["", "## Verdict", ""]
    if {*roles.values()} <= held.keys() and {"full", "rag", "graph"} <= roles.keys():
        v = pareto(metrics, roles["full"], roles["rag"], roles["graph"]).first()
        lines += ["passed" if v["passed"] else "failed", "", *[f"- {c.removesuffix('_ok')}: {'OK' if v[c] else 'NG'}" for c in ("accuracy_ok", "tokens_ok", "latency_ok")]]
    else:
        lines.append("no verdict: answers of a strategy are missing")
    kinds = ("parse_error", "wrong_choice", "unknown_choice")
    lines += ["", "## Failures", "", "| strategy | " + " | ".join(kinds) + " |", "|---" * 4 + "|"]
    lines += [f"| {s} | " + " | ".join(str(lost.get((s, k), 0)) if s in held else "-" for k in kinds) + " |" for s in roles.values()]
    return "\n".join(lines) + "\n"


def canonical_metrics(responses: DataFrame, shape: str) -> DataFrame:
    """question_id, run_index, token counts, latency_ms, model, choice, reasoning and parse_error of stored answers.

    responses has body (JSON). shape says where its fields are: plain (one prompt, no embedding), chunks (the same with
    embedding tokens), graph (totals over two calls). Missing numbers are 0; a total is the stored one, else the sum. A
    graph answer without a parsed body takes the error of its anchor call.
    """
    of = lambda path: F.get_json_object("body", f"$.{path}")
    number = lambda path: F.coalesce(of(path).cast("bigint"), F.lit(0).cast("bigint"))
    graph = shape == "graph"
    if not graph and shape not in ("plain", "chunks"):
        raise ValueError(f"unknown shape: {shape}")
    total, at = ("total_", "answer_generation.") if graph else ("", "")
    read = number(f"{total}input_tokens")
    written = number(f"{total}output_tokens")
    embedded = number("embedding_tokens_estimated" if graph else "embedding_tokens") if shape != "plain" else F.lit(0).cast("bigint")
    added = read + written + embedded
    anchor = of("anchor_extraction.parse_error")
    upstream = F.when(of(f"{at}parsed").isNull(), F.concat(F.lit("anchor_parse_error: "), anchor)) if graph else F.lit(None).cast("string")
    return responses.select(
        F.coalesce(of("question_id"), F.lit("")).alias("question_id"),
        number("run_index").alias("run_index"),
        read.alias("input_tokens"),
        written.alias("output_tokens"),
        embedded.alias("embedding_tokens"),
        (added if shape == "plain" else F.coalesce(of("total_tokens").cast("bigint"), added)).alias("total_tokens"),
        number(f"{total}latency_ms").alias("latency_ms"),
        F.coalesce(of(f"{at}model"), F.lit("")).alias("model"),
        F.lower(F.btrim(of(f"{at}parsed.choice"))).alias("choice"),
        F.coalesce(of(f"{at}parsed.reasoning"), F.lit("")).alias("reasoning"),
        F.coalesce(of(f"{at}parse_error"), upstream).alias("parse_error"),
    )


def blind_labels(question_ids: list[str], strategies: list[str], seed: int | None = None) -> dict[str, dict[str, str]]:
    """For each question, the strategy behind each letter, shuffled anew; one generator goes through all questions."""
    rng, out = random.Random(seed), {}
    for question in question_ids:
        shuffled = [*strategies]
        rng.shuffle(shuffled)
        out[question] = dict(zip(string.ascii_uppercase, shuffled, strict=False))
    return out
