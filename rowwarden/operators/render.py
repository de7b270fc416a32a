"""Issues as text for people and machines: few collected rows on the driver, or columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences for codes; braces name parameters.
MESSAGES = {
    "missing": "is required", "type_mismatch": "has the wrong type", "too_small": "must be at least {minimum}", "too_large": "must be at most {maximum}",
    "not_in_range": "must be between {minimum} and {maximum}", "wrong_length": "must have length {length}", "empty": "must not be empty",
    "pattern_mismatch": "must match {pattern}", "invalid_email": "must be an e-mail address", "invalid_hostname": "must be a host name", "invalid_url": "must be a URL",
    "invalid_uuid": "must be a UUID", "not_ascii": "must be ASCII", "not_trimmed": "must not begin or end with white space", "not_lowercased": "must be lower case",
    "missing_prefix": "must start with {prefix}", "missing_suffix": "must end with {suffix}", "missing_substring": "must contain {substring}", "not_one_of": "must be one of {options}",
    "not_positive": "must be positive", "not_negative": "must be negative", "negative": "must not be negative", "not_multiple": "must be a multiple of {multipleOf}",
    "not_finite": "must be finite", "wrong_count": "must have {minimum} to {maximum} items", "not_unique": "must not repeat items", "date_not_before": "must be before {bound}",
    "date_not_after": "must be after {bound}", "date_not_between": "must be between {minimum} and {maximum}", "invalid_date": "must be a date", "unknown_key": "is not a known key", "duplicate_key": "is a repeated key",
    "missing_column": "is a required column", "malformed_document": "is not a well-formed document", "not_representable": "can't be written", "fallback_applied": "was replaced by its fallback",
    "unknown_variant": "must be one of {options}", "number_overflow": "is out of range", "invalid_utf8": "is not UTF-8", "trailing_content": "has content after its end", "depth_exceeded": "is nested too deeply",
    "too_many_bytes": "is too long", "extras_key_collision": "collides with a declared key", "date_format_fallback": "is in another format than the first",
}


#: Names of types in sentences.
KINDS = {"long": "integer", "int": "integer", "double": "number", "float": "number", "timestamp": "date"}


def message(code: str, params: dict | None = None, received: str | None = None) -> str:
    params = params or {}
    if "message" in params:
        return params["message"]
    if code == "type_mismatch" and "expected" in params:
        kind = KINDS.get(params["expected"], params["expected"])
        return f"must be a{'n' if kind[:1] in tuple('aeiou') else ''} {kind}" + ("" if received is None else f", found {received}")
    if code == "unknown_key" and received is not None:
        hint = params.get("didYouMean")
        return f'unknown key "{received}"' + (f'; did you mean "{hint}"?' if hint else "")
    try:
        return MESSAGES.get(code, code).format(**params)
    except KeyError:
        return MESSAGES.get(code, code)


def message_column(issue: Column) -> Column:
    """The sentence of an issue, in the JVM."""
    sentences = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    text = F.coalesce(F.try_element_at(sentences, issue["code"]), issue["code"])
    params = F.coalesce(issue["params"], F.create_map().cast("map<string,string>"))
    expected = F.try_element_at(params, F.lit("expected"))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), expected), expected)
    mismatch = F.concat(F.lit("must be a"), F.when(F.substring(kind, 1, 1).isin(*"aeiou"), "n ").otherwise(" "), kind, F.coalesce(F.concat(F.lit(", found "), issue["received"]), F.lit("")))
    hint = F.coalesce(F.concat(F.lit('; did you mean "'), F.try_element_at(params, F.lit("didYouMean")), F.lit('"?')), F.lit(""))
    unknown = F.concat(F.lit('unknown key "'), issue["received"], F.lit('"'), hint)
    text = F.coalesce(F.when(issue["code"] == "type_mismatch", mismatch).when(issue["code"] == "unknown_key", unknown), text)
    filled = F.aggregate(F.map_entries(params), text, lambda t, p: F.replace(t, F.concat(F.lit("{"), p["key"], F.lit("}")), p["value"]))
    return F.coalesce(F.try_element_at(params, F.lit("message")), filled)


def _number(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def plain(source: str, rows: list, warnings: list | None = None) -> str:
    """``source:line:column: error: path message`` and an excerpt for each issue, and a footer with counts.

    Issues that have no place, or weren't located, have no line. Rows come in order of position, as :func:`locate` leaves them.
    """
    warnings, out = warnings or [], []
    for kind, found in (("error", rows), ("warning", warnings)):
        for r in found:
            r = r if isinstance(r, dict) else r.asDict()
            at = f":{r['line']}:{r['column']}" if r.get("line") else ""
            sentence = " ".join(filter(None, (r["path"], message(r["code"], r["params"], r.get("received")))))
            out.append("\n".join(filter(None, (f"{source}{at}: {kind}: {sentence}", r.get("excerpt")))) + "\n")
    footer = ", ".join(_number(len(x), what) for x, what in ((rows, "error"), (warnings, "warning")) if x)
    return "\n".join([*out, *([footer] if footer else [])]) + ("\n" if out else "")


def plain_column(source: str | Column, issues: Column, warnings: Column | None = None) -> Column:
    """The same as a column, of issues located with excerpts."""
    source = F.lit(source) if isinstance(source, str) else source

    def lines(found: Column, kind: str) -> Column:
        at = lambda i: F.when(i["line"].isNotNull(), F.concat(F.lit(":"), i["line"].cast("string"), F.lit(":"), i["column"].cast("string"))).otherwise("")
        one = lambda i: F.concat(source, at(i), F.lit(f": {kind}: "), F.concat_ws(" ", F.when(i["path"] != "", i["path"]), message_column(i)), F.lit("\n"), F.coalesce(F.concat(i["excerpt"], F.lit("\n")), F.lit("")), F.lit("\n"))
        return F.array_join(F.transform(found, one), "")

    count = lambda found, what: F.when(F.size(found) > 0, F.concat(F.size(found).cast("string"), F.lit(f" {what}"), F.when(F.size(found) == 1, "").otherwise("s")))
    parts = [(issues, "error"), *([(warnings, "warning")] if warnings is not None else [])]
    footer = F.concat_ws(", ", *[count(c, what) for c, what in parts])
    return F.concat(*[lines(c, what) for c, what in parts], footer, F.when(footer != "", "\n").otherwise(""))


def problem_details(issues: Column) -> Column:
    """An array of issues as JSON in the shape of problem details, status 422."""
    errors = F.transform(issues, lambda i: F.struct(i["path"].alias("path"), i["code"].alias("code"), message_column(i).alias("detail")))
    return F.to_json(F.struct(F.lit("about:blank").alias("type"), F.lit("Unprocessable Content").alias("title"), F.lit(422).alias("status"), errors.alias("errors")))


def report(source: str, issues: Column, warnings: Column | None = None, located: bool = False) -> Column:
    """JSON with the source, whether there are no issues, the issues and the warnings; parameters as texts in order of their names.

    ``located`` issues also have their offset, length, line and column.
    """

    def shown(found: Column) -> Column:
        places = ("offset", "length", "line", "column") if located else ()
        one = lambda i: F.struct(i["path"].alias("path"), i["code"].alias("code"), message_column(i).alias("message"), F.map_from_entries(F.array_sort(F.map_entries(i["params"]))).alias("params"), i["received"].alias("received"), *[i[x].alias(x) for x in places])
        return F.transform(found, one)

    none = F.array().cast("array<string>") if warnings is None else shown(warnings)
    return F.to_json(F.struct(F.lit(source).alias("source"), (F.size(issues) == 0).alias("valid"), shown(issues).alias("issues"), none.alias("warnings")))
