"""Saved map queries: text lines and mesh addresses to columns.

A row that cannot be answered keeps its place and says why in ``erro``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import InvalidQuery
from panelry.frames import local_frame
from panelry.functions.codes import CODE_OF_STATE, map_value
from panelry.functions.text import strip
from panelry.operators.areas import Cut

# The pieces a line is read by: blanks, an escape with what it escapes, a quote, anything else.
_PIECE = r"""(?s)([ \t\r\n]+|\\.?|["']|[^ \t\r\n"'\\]+)"""
_BLANKS = r"^[ \t\r\n]"
# Scheme, host, path and query of an address.
_ADDRESS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def lex(text: Column) -> Column:
    """Words of a line as a shell would cut them: ``struct<mode, word, words>``.

    An automaton folded over the pieces.  Outside quotes a backslash takes the next sign as it is;
    single quotes take everything; inside double quotes a backslash escapes only a double quote or
    itself.  ``mode`` tells how the line ended: blank (all words closed), ``word``, inside a quote
    (``single``, ``double``), or ``escape`` where nothing follows a backslash.
    """
    start = F.struct(
        F.lit("").alias("mode"), F.lit("").alias("word"), F.array().cast("array<string>").alias("words")
    )

    def state(s: Column, mode, added: Column | str = "") -> Column:
        word = F.concat(s["word"], F.lit(added) if isinstance(added, str) else added)
        return F.struct(
            (F.lit(mode) if isinstance(mode, str) else mode).alias("mode"), word.alias("word"), s["words"].alias("words")
        )

    def closed(s: Column) -> Column:
        words = F.when(s["mode"] == "", s["words"]).otherwise(F.concat(s["words"], F.array(s["word"])))
        return F.struct(F.lit("").alias("mode"), F.lit("").alias("word"), words.alias("words"))

    def step(s: Column, x: Column) -> Column:
        mode, escaped, lone = s["mode"], F.substring(x, 2, 1), x == "\\"
        is_escape = x.startswith("\\")
        single = (
            F.when(x.isin("'", "\\'"), state(s, "word", F.rtrim(x, F.lit("'"))))
            .otherwise(state(s, "single", x))
        )
        double = (
            F.when(x == '"', state(s, "word"))
            .when(lone, state(s, "escape"))
            .when(is_escape & escaped.isin('"', "\\"), state(s, "double", escaped))
            .otherwise(state(s, "double", x))
        )
        plain = (
            F.when(x.rlike(_BLANKS), closed(s))
            .when(x == "'", state(s, "single"))
            .when(x == '"', state(s, "double"))
            .when(lone, state(s, "escape"))
            .when(is_escape, state(s, "word", escaped))
            .otherwise(state(s, "word", x))
        )
        return F.when(mode == "single", single).when(mode == "double", double).otherwise(plain)

    return F.aggregate(
        F.regexp_extract_all(text, F.lit(_PIECE), F.lit(1)),
        start,
        step,
        lambda s: F.when(s["mode"] == "word", closed(s)).otherwise(s),
    )


def parse_lines(lines: DataFrame, line: str = "linha") -> DataFrame:
    """Query lines to ``variavel, url, anos, opcoes, erro``; blanks and comments drop out.

    Each word is known by its form: an address, a year, an option, and the
    first other one is the variable.  A comment begins at the first ``#``, also
    inside a quote, which then stays open and is an error.
    """
    text = strip(F.substring_index(F.col(line), "#", 1))

    def is_address(w: Column) -> Column:
        return w.startswith("http")

    def is_year(w: Column) -> Column:
        return w.rlike(r"^(19|20)\d{2}$")

    def is_option(w: Column) -> Column:
        return ~is_address(w) & ~is_year(w) & w.contains("=")

    entries = F.transform(
        F.filter("__words", is_option),
        lambda w: F.struct(
            F.upper(F.substring_index(w, "=", 1)).alias("key"),
            F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("value"),
        ),
    )
    # The last value of a repeated option counts.
    later = F.filter(
        "__entries",
        lambda e, i: ~F.exists(
            F.slice("__entries", i + 2, F.size("__entries")), lambda x: x["key"] == e["key"]
        ),
    )
    variable = F.get(
        F.filter("__words", lambda w: ~is_address(w) & ~is_year(w) & ~w.contains("=")), F.lit(0)
    )
    years = F.array_sort(F.transform(F.filter("__words", is_year), lambda w: w.cast("int")))
    url = F.element_at(F.filter("__words", is_address), -1)
    missing = (F.col("variavel") == "") | (F.col("url") == "")
    error = (
        F.when(F.col("__lexed.mode").isin("single", "double"), "a quote is not closed")
        .when(F.col("__lexed.mode") == "escape", "nothing follows the last backslash")
        .when(missing, "the line has no variable or no mesh address")
    )
    return (
        lines.withColumn("__text", text)
        .filter(F.col("__text") != "")
        .withColumn("__lexed", F.explode(F.array(lex(F.col("__text")))))
        .withColumn("__words", F.col("__lexed.words"))
        .withColumn("__entries", entries)
        .withColumns({
            "variavel": F.coalesce(F.upper(variable), F.lit("")),
            "url": F.coalesce(F.when(F.exists("__words", is_address), url), F.lit("")),
            "anos": years,
            "opcoes": F.map_from_entries(later),
        })
        .withColumn("erro", error)
        .drop("__text", "__lexed", "__words", "__entries")
    )


def _parameter(query: Column, key: str) -> Column:
    """Last non-blank value of a parameter, decoded."""
    values = F.filter(
        F.split(query, "&"), lambda p: p.startswith(f"{key}=") & (F.length(p) > len(key) + 1)
    )
    last = F.when(F.size(values) > 0, F.element_at(values, -1))
    return F.try_url_decode(F.regexp_replace(last, f"^{key}=", ""))


def parse_addresses(df: DataFrame, url: str = "url") -> DataFrame:
    """Mesh addresses to ``escopo, codigo, intrarregiao, qualidade, coluna,
    coluna_filtro, valor_filtro, coluna_nome`` and ``erro``."""
    address = F.col(url)
    parts = df.withColumns({
        "__scheme": F.lower(F.regexp_extract(address, _ADDRESS, 1)),
        "__host": F.regexp_extract(address, _ADDRESS, 2),
        "__path": F.filter(
            F.split(F.regexp_extract(address, _ADDRESS, 3), "/"), lambda p: p != ""
        ),
        "__query": F.regexp_extract(address, _ADDRESS, 4),
    }).withColumns({
        "__at": F.array_position("__path", "malhas").cast("int"),
        "__level": F.lower(_parameter(F.col("__query"), "intrarregiao")),
        "__quality": _parameter(F.col("__query"), "qualidade"),
    })
    level, scope = F.col("__level"), F.col("__scope")
    parts = parts.withColumns({
        "__scope": F.when(F.col("__at") > 0, F.get("__path", F.col("__at"))),
        "__code": F.when(F.col("__at") > 0, F.upper(F.get("__path", F.col("__at") + 1))),
    })
    filter_column = map_value(scope, fixed.SCOPE_FILTER)
    digits = F.when(F.col("__code").rlike(r"^\d+$"), F.col("__code").try_cast("bigint"))
    filter_value = F.coalesce(map_value(F.col("__code"), CODE_OF_STATE).cast("bigint"), digits)
    column = F.coalesce(map_value(level, fixed.LEVELS), F.when(level.isNull(), filter_column))
    known = ", ".join(sorted(fixed.LEVELS))
    error = (
        F.when(
            ~F.col("__scheme").isin("http", "https") | ~F.col("__host").contains(fixed.MESH_HOST),
            F.lit(f"not a mesh address of {fixed.MESH_HOST}"),
        )
        .when(F.col("__code").isNull(), "the mesh address has no scope and code")
        .when(
            level.isNull() & F.col("__quality").isNull(),
            "the mesh address was cut at its first '&': put it in quotes (aspas)",
        )
        .when(
            level.isNotNull() & map_value(level, fixed.LEVELS).isNull(),
            F.concat(F.lit("unknown intrarregiao "), level, F.lit(f"; known: {known}")),
        )
        .when(column.isNull(), "a whole country needs an intrarregiao level")
        .when(
            filter_column.isNotNull() & filter_value.isNull(),
            F.concat(F.lit("unknown code of "), scope, F.lit(": "), F.col("__code")),
        )
    )
    previous = F.col("erro") if "erro" in df.columns else F.lit(None).cast("string")
    parts = parts.withColumn("erro", F.coalesce(previous, error))
    valid = F.col("erro").isNull()
    return parts.withColumns({
        "escopo": F.when(valid, scope),
        "codigo": F.when(
            valid,
            F.when(filter_column.isNotNull(), filter_value.cast("string")).otherwise(
                F.col("__code")
            ),
        ),
        "intrarregiao": F.when(valid, level),
        "qualidade": F.when(valid, F.coalesce("__quality", F.lit("intermediaria"))),
        "coluna": F.when(valid, column),
        "coluna_filtro": F.when(valid, filter_column),
        "valor_filtro": F.when(valid & filter_column.isNotNull(), filter_value),
        "coluna_nome": F.when(valid, map_value(column, fixed.AREA_NAME)),
        "malha": F.when(valid, normalized_address(address, F.col("__query"))),
    }).drop("__scheme", "__host", "__path", "__query", "__at", "__level", "__quality",
            "__scope", "__code")


def normalized_address(url: Column, query: Column) -> Column:
    """The address with its format parameter, which identifies the mesh."""
    separator = F.when(query == "", F.when(url.contains("?"), "").otherwise("?")).otherwise("&")
    added = F.concat(url, separator, F.lit(f"formato={fixed.MESH_FORMAT}"))
    return F.when(_parameter(query, "formato").isNotNull(), url).otherwise(added)


def parse_cuts(queries: DataFrame, line: str = "linha") -> DataFrame:
    """Saved query lines to cut columns in one pass; no row is lost to an error."""
    return parse_addresses(parse_lines(queries, line))


def cut_from_address(spark: SparkSession, url: str) -> Cut:
    """Cut of one address; an address that does not serve is an error."""
    row = parse_addresses(local_frame(spark, {"url": "string"}, [(url,)])).first()
    if row.erro:
        raise InvalidQuery(f"{row.erro}: {url}")
    return cut_of(row)


def cut_of(row) -> Cut:
    return Cut(
        column=row.coluna,
        filter_column=row.coluna_filtro,
        filter_value=row.valor_filtro,
        name_column=row.coluna_nome,
        level=row.intrarregiao,
        scope=row.escopo,
        code=row.codigo,
        mesh=row.malha,
    )
