"""Document formats: detection from names and MIME types, chips, share types.  Column expressions and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each format, in the order in which formats are tried
EXTENSIONS = {
    "PDF": "pdf",
    "MARKDOWN": "md markdown mdown",
    "TEXT": "txt text log",
    "CSV": "csv tsv",
    "DOC": "doc",
    "DOCX": "docx docm dotx dotm",
    "ODT": "odt ott",
    "EPUB": "epub",
    "CODE": (
        "c h cc cpp cxx hpp cs java kt kts scala groovy clj js jsx mjs cjs ts tsx py pyw rb rake go rs php swift m mm dart lua pl r "
        "ex exs erl hs ml jl sh bash zsh fish ksh ps1 bat cmd sql graphql gql json jsonc json5 yaml yml toml ini cfg conf env "
        "properties xml svg html htm css scss sass less vue svelte gradle cmake mk makefile dockerfile patch diff gitignore editorconfig"
    ),
    "PPTX": "pptx pptm potx potm ppsx ppsm",
}
#: MIME types of each format, lower case; the first is the declared one
MIME_TYPES = {
    "PDF": ["application/pdf"],
    "MARKDOWN": ["text/markdown", "text/x-markdown"],
    "TEXT": ["text/plain"],
    "CSV": ["text/csv", "text/comma-separated-values", "text/tab-separated-values"],
    "DOC": ["application/msword"],
    "DOCX": [
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.template",
        "application/vnd.ms-word.document.macroenabled.12",
        "application/vnd.ms-word.template.macroenabled.12",
    ],
    "ODT": ["application/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.text-template"],
    "EPUB": ["application/epub+zip"],
    "CODE": [],
    "PPTX": [
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.openxmlformats-officedocument.presentationml.template",
        "application/vnd.openxmlformats-officedocument.presentationml.slideshow",
        "application/vnd.ms-powerpoint.presentation.macroenabled.12",
        "application/vnd.ms-powerpoint.template.macroenabled.12",
        "application/vnd.ms-powerpoint.slideshow.macroenabled.12",
    ],
}
#: Chips in display order
GROUPS = ["PDF", "WORD", "ODT", "EPUB", "MARKDOWN", "TEXT", "CSV", "TSV", "CODE", "POWERPOINT"]
GENERIC_TYPES = ["application/octet-stream", "application/binary", "*/*"]
LOCATION_KINDS = {"PAGE": 0, "CHUNK": 1, "BLOCK": 2, "CHAR": 3}


def lookup(spark: SparkSession, kind: str) -> DataFrame:
    """(key, fmt) rows of the extension or MIME table; a few dozen rows, always small enough to broadcast."""
    table = {f: v.split() for f, v in EXTENSIONS.items()} if kind == "extension" else MIME_TYPES
    return spark.createDataFrame([(k, f) for f, keys in table.items() for k in keys], "key string, fmt string")


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty where the name has none."""
    return F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?s)\.([^.]*)$", 1)


def from_table(key: Column, table: dict[str, list[str]]) -> Column:
    """The format whose list holds the key, as one map literal that whole-stage code generation keeps."""
    pairs = [F.lit(x) for f, keys in table.items() for k in keys for x in (k, f)]
    return F.try_element_at(F.create_map(*pairs), key)


def detect(name: Column, mime: Column | None = None) -> Column:
    """by extension, else by the whole name if it has no dot, else by MIME type, else UNKNOWN."""
    ext = {f: v.split() for f, v in EXTENSIONS.items()}
    lower = F.lower(F.coalesce(name, F.lit("")))
    found = [from_table(extension(name), ext), from_table(lower, ext)]
    if mime is not None:
        found.append(from_table(F.lower(F.coalesce(mime, F.lit(""))), {f: k for f, k in MIME_TYPES.items() if k}))
    return F.coalesce(*found, F.lit("UNKNOWN"))


def group(fmt: Column, title: Column) -> Column:
    """the chip of a format; null for UNKNOWN."""
    return (
        F.when(fmt.isin("DOC", "DOCX"), "WORD")
        .when(fmt == "CSV", F.when(extension(title) == "tsv", "TSV").otherwise("CSV"))
        .when(fmt == "PPTX", "POWERPOINT")
        .when(fmt == "UNKNOWN", F.lit(None))
        .otherwise(fmt)
    )


def declared_type(fmt: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for f, k in MIME_TYPES.items() if k for x in (f, k[0])]), fmt)


def share_type(fmt: Column, reported: Column) -> Column:
    """the reported type unless it is missing, generic, or plain text for a format that declares another."""
    own, said = declared_type(fmt), F.nullif(F.trim(reported), F.lit(""))
    return (
        F.when(said.isNull() | said.isin(GENERIC_TYPES), F.coalesce(own, F.lit("*/*")))
        .when((said == "text/plain") & own.isNotNull() & (own != "text/plain"), own)
        .otherwise(said)
    )


def location_kind(fmt: Column) -> Column:
    """The kind of place a format is read by: pages, chunks of lines, blocks or characters."""
    return (
        F.when(fmt.isin("PDF", "PPTX"), LOCATION_KINDS["PAGE"]).when(fmt.isin("TEXT", "CODE", "CSV", "UNKNOWN"), LOCATION_KINDS["CHUNK"])
        .when(fmt == "MARKDOWN", LOCATION_KINDS["CHAR"]).otherwise(LOCATION_KINDS["BLOCK"])
    )
