"""Payload text and the download commands in it, as columns.

A command line is cut into one segment per mention of its tool; the words of a segment are told
apart by what stands before them (options that take a value, switches), and the host is the first
word that is neither.  All of it is string and array functions, so it runs next to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_hex(payload: Column | str) -> Column:
    p = F.regexp_replace(_c(payload), r"\s", "")
    return (F.length(p) % 2 == 0) & p.rlike("^[0-9A-Fa-f]*$")


def hex_to_text(payload: Column | str) -> Column:
    """UTF-8 text of a hex payload; null for odd length, other digits or invalid UTF-8."""
    raw = F.when(is_hex(payload), F.unhex(F.regexp_replace(_c(payload), r"\s", "")))
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def to_hex(data: Column | str) -> Column:
    return F.lower(F.hex(_c(data)))


def latin1(payload: Column | str) -> Column:
    """Byte-by-byte reading of a hex payload."""
    return F.decode(F.when(is_hex(payload), F.unhex(F.regexp_replace(_c(payload), r"\s", ""))), "ISO-8859-1")


def looks_printable(payload: Column | str, first: int = 15) -> Column:
    """Whether at least half of the first bytes are printable, white space or zero."""
    n = F.least(F.lit(first), F.floor(F.length(_c(payload)) / 2).cast("int"))
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(_c(payload), i * 2 - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    good = F.size(F.filter(codes, lambda b: b.between(33, 126) | b.isin(0, 9, 10, 13, 32)))
    return F.when(is_hex(payload), 2 * good >= F.size(codes))


def clean_text(text: Column | str) -> Column:
    """A payload made ready for cutting: unescaped, separators blanked, ends trimmed."""
    t = F.regexp_replace(F.replace(_c(text), F.lit("+"), F.lit(" ")), "%(?![0-9A-Fa-f]{2})", "%25")
    t = F.coalesce(F.try_url_decode(t), _c(text))
    for old in (";", "`", "+", "${IFS}", "\r", "\n", "\t", "\\r", "\\n", "\\t", "'", "("):
        t = F.replace(t, F.lit(old), F.lit(" "))
    t = F.replace(t, F.lit("\\"), F.lit(""))
    for scheme in ("http://", "https://"):
        t = F.replace(t, F.lit(f"{scheme} "), F.lit(scheme))
    t = F.replace(F.replace(t, F.lit("  "), F.lit(" ")), F.lit("&"), F.lit(" "))
    return F.trim(t)


def neutral_text(text: Column | str) -> Column:
    """Cleaned text without mentions of a tool that are no command: trailing or in an agent name."""
    t = F.regexp_replace(_c(text), "(wget|curl)$", "")
    return F.replace(F.replace(t, F.lit("User-Agent: curl"), F.lit("")), F.lit(" libcurl/"), F.lit(""))


def segments(text: Column | str, tool: str) -> Column:
    """The parts of a text that begin with the tool's name, without the name."""
    parts = F.split(_c(text), rf"\Q{tool}\E")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def is_url(text: Column | str) -> Column:
    return _c(text).rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


#: Options followed by a value, and switches; fixed values.
VALUE_OPTIONS = {"wget": ("-g", "-l", "-r", "-O", "-U"), "curl": ("-A",)}


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _with_scheme(host: Column) -> Column:
    return F.when(host.startswith("http"), host).otherwise(F.concat(F.lit("http://"), host))


def command_url(segment: Column | str, tool: str) -> Column:
    """URL that a command fetches; null if there is none.

    A URL as first word is it; else the host is the value of wget's ``-g`` or the first word that
    is neither an option nor an option's value, and wget's ``-r`` value is its path.
    """
    takes = F.array(*[F.lit(o) for o in VALUE_OPTIONS[tool]])

    def plain(words: Column) -> Column:
        return F.get(F.filter(words, lambda w, i: ~w.startswith("-") & ~F.coalesce(F.array_contains(takes, F.get(words, i - 1)), F.lit(False))), F.lit(0))

    def value(words: Column, name: str) -> Column:
        at = F.array_position(words, name)
        return F.nullif(F.when(at > 0, F.get(words, at.cast("int"))), F.lit(""))

    def with_path(url: Column, path: Column) -> Column:
        return F.when(path.isNull(), url).otherwise(F.concat(url, F.when(url.endswith("/") | path.startswith("/"), "").otherwise("/"), path))

    def of(words: Column) -> Column:
        host = F.coalesce(value(words, "-g"), plain(words)) if tool == "wget" else plain(words)
        made = _let(_with_scheme(host), lambda u: F.when(is_url(u), with_path(u, value(words, "-r")) if tool == "wget" else u))
        return F.when(is_url(F.get(words, F.lit(0))), F.get(words, F.lit(0))).otherwise(made)

    split = F.array_remove(F.split(F.trim(_c(segment)), " "), "")
    return _let(_let(split, of), lambda u: F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("http://"), u)))


def url_parts(url: Column | str) -> Column:
    """struct(server, port, name): port 80 unless the authority has exactly one colon."""
    authority = F.regexp_extract(_c(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    pair = F.split(authority, ":")
    one = F.size(pair) == 2
    return F.struct(F.when(one, F.get(pair, F.lit(0))).otherwise(authority).alias("server"), F.when(one, F.get(pair, F.lit(1))).otherwise("80").alias("port"), F.element_at(F.split(_c(url), "/"), -1).alias("name"))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_c(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def tool_of(text: Column | str) -> Column:
    """wget before curl; null if neither is mentioned."""
    return F.when(_c(text).contains("wget"), "wget").when(_c(text).contains("curl"), "curl")


#: How the arguments of each tool's command give a URL.  Other tools can be passed in, by name.
PARSERS: dict[str, Callable[[Column], Column]] = {"wget": lambda segment: command_url(segment, "wget"), "curl": lambda segment: command_url(segment, "curl")}


def _tool_urls(text: Column, tool: str, parse: Callable[[Column], Column]) -> Column:
    made = F.filter(F.transform(segments(text, tool), parse), lambda u: u.isNotNull())
    return F.transform(made, lambda u: F.struct(F.lit(tool).alias("tool"), u.alias("url"), url_parts(u).alias("parts")))


def _parsers(tools) -> dict[str, Callable[[Column], Column]]:
    return dict(tools) if isinstance(tools, Mapping) else {tool: PARSERS[tool] for tool in tools}


def urls(text: Column | str, tools=("wget", "curl")) -> Column:
    """array<struct(tool, url, parts)> of all commands, tools in the given order.

    ``tools``: names with a parser in PARSERS, or a mapping of names to parsers (a command's
    arguments as a column -> its URL as a column, null if it has none).
    """
    return _let(neutral_text(clean_text(text)), lambda t: F.concat(*[_tool_urls(t, tool, parse) for tool, parse in _parsers(tools).items()]))


def extract_urls(df: DataFrame, text: str, tools=("wget", "curl")) -> DataFrame:
    """One row per command with a URL: the table's columns and tool, url, server, port, name."""
    return df.select("*", F.explode(urls(text, tools)).alias("_u")).select("*", "_u.tool", "_u.url", "_u.parts.*").drop("_u")


def url_table(spark: SparkSession, name: str, parsers: Mapping[str, Callable[[str], str | None]]) -> None:
    """Register a table function ``name(text)`` of ``tool, url``, for parsers that no column can say.

    ``parsers`` are Python functions of a command's arguments; rows go to them in Arrow batches.  The text is one that
    ``clean_text`` and ``neutral_text`` have made, as in ``SELECT p.*, u.* FROM payloads p, LATERAL name(p.text) u``.
    """
    given = dict(parsers)

    class Urls:
        def eval(self, text: str):
            for tool, parse in given.items():
                for part in (text or "").split(tool)[1:]:
                    if (url := parse(part)) is not None:
                        yield tool, url

    spark.udtf.register(name, F.udtf(Urls, returnType="tool string, url string", useArrow=True))


def parsed_by(df: DataFrame, text: str, parsers: Mapping[str, Callable[[str], str | None]], name: str = "duskwatch_urls") -> DataFrame:
    """The columns of :func:`extract_urls`, with Python parsers by way of :func:`url_table`."""
    spark = df.sparkSession
    url_table(spark, name, parsers)
    cleaned = df.withColumn("_text", neutral_text(clean_text(text)))
    found = spark.sql(f"SELECT p.*, u.tool, u.url FROM {{p}} p, LATERAL {name}(p._text) u", p=cleaned)
    return found.withColumn("_parts", url_parts("url")).select(*df.columns, "tool", "url", "_parts.*")


def first_url_with_path(text: Column | str, tools=("wget", "curl")) -> Column:
    """struct(tool, url, server, port, name, path) of the first command with a URL; null if there is none."""
    first = F.get(urls(text, tools), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["tool"].alias("tool"), first["url"].alias("url"), first["parts"]["server"].alias("server"), first["parts"]["port"].alias("port"), first["parts"]["name"].alias("name"), url_path(first["url"]).alias("path")))


def first_url(text: Column | str) -> Column:
    return F.get(urls(text), F.lit(0))["url"]


def unparsed(text: Column | str) -> Column:
    """Whether fewer URLs were found than tools are mentioned."""
    t = neutral_text(clean_text(text))
    expected = sum((F.when(t.contains(tool), 1).otherwise(0) for tool in ("wget", "curl")), F.lit(0))
    return F.size(urls(text)) < expected


def payload_kind(payload: Column | str) -> Column:
    """downloader (decodes and has a URL), ascii (decodes) or hex."""
    named = lambda t: t.contains("wget") | t.contains("curl")
    return _let(hex_to_text(payload), lambda t: F.when(t.isNull(), "hex").when(named(t) & first_url(t).isNotNull(), "downloader").otherwise("ascii"))


def escaped(text: Column | str) -> Column:
    """Control characters and backslashes written as escapes."""
    t = F.replace(_c(text), F.lit("\\"), F.lit("\\\\"))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = F.replace(t, F.lit(raw), F.lit(name))
    return t
