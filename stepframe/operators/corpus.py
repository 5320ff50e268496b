"""Inventories over a table of step-language scripts (`path`, `text`), as regular-expression scans in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Block kinds by procedure name; other procedures are PROC_UNKNOWN.
PROCEDURES = {
    "SORT": "PROC_SORT", "SQL": "PROC_SQL", "IML": "PROC_IML", "FCMP": "PROC_FCMP", "MEANS": "PROC_MEANS", "SUMMARY": "PROC_MEANS",
    "FREQ": "PROC_FREQ", "TRANSPOSE": "PROC_TRANSPOSE", "IMPORT": "PROC_IMPORT", "EXPORT": "PROC_EXPORT", "PRINT": "PROC_PRINT",
    "CONTENTS": "PROC_CONTENTS", "DATASETS": "PROC_DATASETS", "OPTMODEL": "PROC_OPTMODEL",
}

# A comment, a quoted text, or a run of anything else; what stands in the first two is no code.
_PIECE = r"(?s)/\*.*?(?:\*/|\z)|'[^']*'|\"[^\"]*\"|[^/'\"]+|."
_MASK = "\u0001"
_REFERENCE = r"&(\w+)"
_BLOCK_TYPE = "array<struct<start:int,end:int,procedure:string,statements:array<string>>>"


def _spread(scripts: DataFrame) -> DataFrame:
    """(path, text) dealt over as many tasks as the shuffle has. Reading is quick and a scan of a script is not: a million
    small scripts may lie in one file, which is read by a task or two."""
    return scripts.select("path", "text").repartition(int(scripts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _statements(text: str | Column) -> Column:
    """The statements of a script without comments; semicolons in quotes are masked, and line breaks are all kept."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda x: F.when(
        x.startswith("/*"), F.regexp_replace(x, r"[^\n]", "")).when(x.startswith("'") | x.startswith('"'), F.translate(x, ";", _MASK)).otherwise(x))
    parts = F.split(F.array_join(pieces, ""), ";")
    return F.slice(parts, 1, F.size(parts) - 1)


def _word(statement: Column, n: int = 1) -> Column:
    """The n-th word of a statement in upper case, empty if it isn't one."""
    return F.upper(F.regexp_extract(statement, r"^\s*" + r"[%\w]+\s+" * (n - 1) + r"([%\w]+)", 1))


def _grouped(statements: Column) -> Column:
    """Statements as blocks: from DATA or PROC to RUN, or QUIT for procedures, and for PROC SQL to QUIT alone."""
    empty = F.struct(F.lit(1).alias("line"), F.lit(None).cast("string").alias("procedure"), F.lit(0).alias("start"),
                     F.array().cast("array<string>").alias("body"), F.array().cast(_BLOCK_TYPE).alias("done"))

    def step(a: Column, statement: Column) -> Column:
        first = _word(statement)
        opens = a.procedure.isNull() & ((first == "PROC") | ((first == "DATA") & statement.rlike(r"(?i)^\s*data\s+[^\s=]")))
        alone = statement.rlike(r"^\s*\w+\s*$")
        closes = alone & F.when(a.procedure == "", first == "RUN").when(a.procedure == "SQL", first == "QUIT").otherwise(first.isin("RUN", "QUIT"))
        lead = a.line + _breaks(F.regexp_extract(statement, r"^\s*", 0))
        after = a.line + _breaks(statement)
        body = F.concat(a.body, F.array(statement))
        none = F.array().cast("array<string>")
        name = F.when(first == "PROC", _word(statement, 2)).otherwise("")
        return (
            F.when(opens, F.struct(after.alias("line"), name.alias("procedure"), lead.alias("start"), F.array(statement).alias("body"), a.done.alias("done")))
            .when(a.procedure.isNull(), F.struct(after.alias("line"), a.procedure.alias("procedure"), a.start.alias("start"), none.alias("body"), a.done.alias("done")))
            .when(closes, F.struct(after.alias("line"), F.lit(None).cast("string").alias("procedure"), F.lit(0).alias("start"), none.alias("body"), F.concat(a.done, F.array(F.struct(
                a.start.alias("start"), after.alias("end"), a.procedure.alias("procedure"), body.alias("statements")))).alias("done")))
            .otherwise(F.struct(after.alias("line"), a.procedure.alias("procedure"), a.start.alias("start"), body.alias("body"), a.done.alias("done"))))

    return F.aggregate(statements, empty, step).done


def blocks(scripts: DataFrame) -> DataFrame:
    """(block_id = path:line, path, start_line, end_line, ordinal, block_type, raw, statements) of every block, in file order.

    Comments are left out and don't open blocks; semicolons in quotes end no statement. `raw` is the block's code. A
    block is put together inside its script's row: the scripts are shuffled once, to spread the work, and nothing after that.
    """
    found = _spread(scripts).select("path", F.posexplode(_grouped(_statements("text"))).alias("ordinal", "b"))
    known = F.create_map(*[F.lit(x) for pair in PROCEDURES.items() for x in pair])
    kind = F.when(F.col("b.procedure") == "", "DATA_STEP").otherwise(F.coalesce(known[F.col("b.procedure")], F.lit("PROC_UNKNOWN")))
    raw = F.trim(F.translate(F.concat(F.array_join("b.statements", ";"), F.lit(";")), _MASK, ";"))
    return found.select(
        F.concat_ws(":", "path", "b.start").alias("block_id"), "path", F.col("b.start").alias("start_line"), F.col("b.end").alias("end_line"), "ordinal",
        kind.alias("block_type"), F.regexp_replace(raw, r"^\s+", "").alias("raw"), F.col("b.statements").alias("statements"))


def inventory(scripts: DataFrame) -> DataFrame:
    """Number of blocks per file and kind."""
    return blocks(scripts).groupBy("path", "block_type").agg(F.count("*").alias("n_blocks"))


def _all(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _names(lists: Column) -> Column:
    """Distinct lower-case names of an array of arrays."""
    return F.array_distinct(F.filter(F.transform(F.flatten(lists), lambda w: F.lower(w)), lambda w: w.rlike(r"^[\w.&]+$")))


def _plain(statement: Column) -> Column:
    """A statement without options in parentheses (up to four deep), and with `name=value` written as one word."""
    for _ in range(4):
        statement = F.regexp_replace(statement, r"\([^()]*\)", " ")
    return F.regexp_replace(statement, r"\s*=\s*", "=")


def _listed(statement: Column) -> Column:
    """The words after the first one that are no options."""
    words = F.filter(F.split(_plain(statement), r"\s+"), lambda w: w != "")
    return F.filter(F.slice(words, 2, F.size(words) + 1), lambda w: ~w.contains("="))


def _option(name: str) -> Column:
    """The values of `name=` in all statements of a block, also within options in parentheses."""
    return F.transform("statements", lambda x: _all(F.regexp_replace(x, r"\s*=\s*", "="), rf"(?i)(?<![\w.]){name}=([\w.&]+)"))


def _selected(statement: Column) -> Column:
    """Tables read by a query: each first word of a FROM list's items, and what follows JOIN."""
    lists = _all(statement, r"(?is)\bfrom\s+([^()]*?)\s*(?=\bwhere\b|\bgroup\b|\border\b|\bhaving\b|\bon\b|\bunion\b|\bexcept\b|\bintersect\b|[()]|\z)")
    items = F.flatten(F.transform(lists, lambda x: F.split(x, r"(?i),|\bjoin\b")))
    return F.concat(F.transform(items, lambda x: F.regexp_extract(x, r"^\s*([\w.&]+)", 1)), _all(statement, r"(?i)\bjoin\s+([\w.&]+)"))


def with_datasets(found: DataFrame) -> DataFrame:
    """Blocks with `inputs` and `outputs`, decided by the first word of each statement: none is dropped.

    DATA names outputs, SET, MERGE, UPDATE and MODIFY name inputs, options aside. In PROC SQL, FROM lists and JOIN are
    inputs, CREATE TABLE or VIEW and INSERT INTO outputs. Other procedures read every DATA= and write every OUT=; PROC
    SORT without OUT= writes what it reads.
    """
    is_data, is_sql, is_sort = (F.col("block_type") == k for k in ("DATA_STEP", "PROC_SQL", "PROC_SORT"))
    none = F.array().cast("array<string>")
    data_in = _names(F.transform("statements", lambda x: F.when(_word(x).isin("SET", "MERGE", "UPDATE", "MODIFY"), _listed(x)).otherwise(none)))
    data_out = _names(F.transform(F.slice("statements", 1, 1), _listed))
    sql_in = _names(F.transform("statements", _selected))
    created = r"(?i)^\s*(?:create\s+(?:table|view)|insert\s+into)\s+([\w.&]+)"
    sql_out = _names(F.transform("statements", lambda x: _all(x, created)))
    proc_in, proc_out = _names(_option("data")), _names(_option("out"))
    in_place = F.when(is_sort & (F.size(proc_out) == 0), proc_in).otherwise(proc_out)
    return found.withColumns({
        "inputs": F.when(is_data, data_in).when(is_sql, sql_in).otherwise(proc_in),
        "outputs": F.when(is_data, data_out).when(is_sql, sql_out).otherwise(in_place),
    })


def dataset_usage(scripts: DataFrame) -> DataFrame:
    """(path, block_id, dataset, direction read/write)."""
    found = with_datasets(blocks(scripts))
    reads = F.transform("inputs", lambda name: F.struct(name.alias("dataset"), F.lit("read").alias("direction")))
    writes = F.transform("outputs", lambda name: F.struct(name.alias("dataset"), F.lit("write").alias("direction")))
    return found.select("path", "block_id", F.inline(F.concat(reads, writes)))


def as_steps(scripts: DataFrame) -> DataFrame:
    """Blocks as step rows for the lineage operators (node, seq, file, inputs, outputs); files in path order."""
    found = with_datasets(blocks(scripts))
    return found.select(F.col("block_id").alias("node"), F.struct("path", "ordinal").alias("seq"), F.col("path").alias("file"), "inputs", "outputs")


def _declared() -> Column:
    """(name, value) of each %LET statement, in order."""
    lets = F.filter(_statements("text"), lambda x: _word(x) == "%LET")
    return F.transform(lets, lambda x: F.struct(
        F.regexp_extract(x, r"(?s)^\s*\S+\s+(\w+)", 1).alias("n"), F.translate(F.regexp_extract(x, r"(?s)=\s*(.*?)\s*$", 1), _MASK, ";").alias("v")))


def macro_variables(scripts: DataFrame) -> DataFrame:
    """(path, name, raw_value) of every %LET."""
    return _spread(scripts).select("path", F.inline(_declared())).toDF("path", "name", "raw_value")


def macro_usages(scripts: DataFrame) -> DataFrame:
    """(macro_name, macro_value, used_in_block_id): one row per block and name; value NULL if never declared.

    The same file's last declaration wins, else the last one by path.
    """
    used = blocks(scripts).select("path", "block_id", F.explode(F.array_distinct(_all(F.upper("raw"), _REFERENCE))).alias("macro_name"))
    lets = _spread(scripts).select("path", F.posexplode(_declared()).alias("at", "let"))
    lets = lets.select("path", "at", F.upper(F.col("let")["n"]).alias("macro_name"), F.col("let")["v"].alias("v"))
    local = lets.groupBy("path", "macro_name").agg(F.max_by("v", "at").alias("local_value"))
    anywhere = lets.groupBy("macro_name").agg(F.max_by("v", F.struct("path", "at")).alias("any_value"))
    return used.join(local, ["path", "macro_name"], "left").join(anywhere, "macro_name", "left").select(
        "macro_name", F.coalesce("local_value", "any_value").alias("macro_value"), F.col("block_id").alias("used_in_block_id"))


def unresolved_macros(scripts: DataFrame) -> DataFrame:
    """References to names that no script declares: (macro_name, used_in_block_id)."""
    used = blocks(scripts).select("block_id", F.explode(F.array_distinct(_all(F.upper("raw"), _REFERENCE))).alias("macro_name"))
    declared = macro_variables(scripts).select(F.upper("name").alias("macro_name")).distinct()
    return used.join(declared, "macro_name", "left_anti").select("macro_name", F.col("block_id").alias("used_in_block_id"))


# Log levels from lowest to highest.
SEVERITIES = ["INFO", "WARNING", "ERROR"]


def log_severity(lines: DataFrame) -> DataFrame:
    """(log_file, severity): the highest level that starts a line of the log; NOTE lines are INFO."""
    level = F.regexp_extract(F.upper(F.trim("line")), r"^(ERROR|WARNING|INFO|NOTE)\b", 1)
    rank = F.when(level == "ERROR", 2).when(level == "WARNING", 1).otherwise(0)
    worst = lines.groupBy("log_file").agg(F.max(rank).alias("rank"))
    return worst.select("log_file", F.array(*[F.lit(s) for s in SEVERITIES])[F.col("rank")].alias("severity"))


def log_links(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(log_file, severity, related_file): one row per known script file a log mentions, one with NULL if none."""
    mentioned = lines.select("log_file", F.explode(_all("line", r"(?i)([\w./-]+\.sas)\b")).alias("file")).distinct()
    linked = mentioned.join(files.select("file").distinct(), "file").select("log_file", F.col("file").alias("related_file"))
    return log_severity(lines).join(linked, "log_file", "left")


# What makes a block risky. Each pattern is matched against the block text.
RISK_RULES = [
    ("call symput", "high", r"(?i)\bcall\s+symputx?\b"),
    ("%include", "high", r"(?i)%include\b"),
    ("dynamic dataset name", "high", r"(?i)\bdata\s+[^;]*&\w+"),
    ("nested macro", "high", r"(?is)%macro\b.*%macro\b"),
    ("proc datasets", "high", r"(?i)\bproc\s+datasets\b"),
    ("%sysfunc or %syscall", "high", r"(?i)%sys(?:func|call)\b"),
    ("retain with array", "high", r"(?is)\bretain\b.*\barray\b|\barray\b.*\bretain\b"),
    ("nested do with retain", "high", r"(?is)\bretain\b.*\bdo\b.*\bdo\b"),
    ("multiple outputs", "medium", r"(?i)^data\s+[\w.]+\s+[\w.]+[\w.\s]*;"),
    ("output inside do", "medium", r"(?is)\bdo\b.*\bif\b.*\boutput\b.*\bend\b"),
    ("merge", "medium", r"(?i)\bmerge\s+\w"),
    ("by group", "medium", r"(?i)\bby\s+\w"),
    ("case expression", "medium", r"(?i)\bcase\s+when\b"),
]


def risk_flags(found: DataFrame) -> DataFrame:
    """(block_id, path, risk, flags): every rule a block matches, and the highest risk among them (low if none)."""
    rules = [(label, risk, F.col("raw").rlike(pattern)) for label, risk, pattern in RISK_RULES]
    rules.append(("unknown procedure", "high", F.col("block_type") == "PROC_UNKNOWN"))
    hit = lambda label, risk: F.struct(F.lit(label).alias("flag"), F.lit(2 if risk == "high" else 1).alias("rank"))
    hits = F.filter(F.array(*[F.when(found_here, hit(label, risk)) for label, risk, found_here in rules]), lambda h: h.isNotNull())
    rank = F.coalesce(F.array_max(F.transform("hits", lambda h: h["rank"])), F.lit(0))
    return found.withColumn("hits", hits).select(
        "block_id", "path", F.array(F.lit("low"), F.lit("medium"), F.lit("high"))[rank].alias("risk"),
        F.array_join(F.transform("hits", lambda h: h["flag"]), ", ").alias("flags"))


def overall_risk(flags: DataFrame) -> DataFrame:
    """(path, overall_risk, n_blocks, n_high): the highest risk of a file's blocks."""
    rank = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    found = flags.groupBy("path").agg(F.max(rank).alias("r"), F.count("*").alias("n_blocks"), F.count_if(F.col("risk") == "high").alias("n_high"))
    return found.select("path", F.array(F.lit("low"), F.lit("medium"), F.lit("high"))[F.col("r")].alias("overall_risk"), "n_blocks", "n_high")
