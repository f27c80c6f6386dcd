"""Problem 5: telling hand-written source from machine-written, minified, vendored files and data saved as code.

Layout statistics of the text (longest and mean line, shares of blanks and alphanumerics, density of numeric
literals, share of long encoded runs, share of lines repeated but for numbers) come first; their thresholds lie a fixed factor beyond what hand-written files of each
language measure. What layout can't show is read from conventions:
names and folders that tools reserve for their output or for third-party code, banners at the start of comments anywhere in
the text, and helpers only compilers emit. Library files that lie elsewhere under another name are found by content: a
file most of whose lines occur in one known library, and in no other, or whose whole content is a library file's, is a copy of it.

Everything runs in the JVM. The text is read once and never shuffled; what is shuffled are line hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cambium.functions.plain import blank, plain_path


@dataclass(frozen=True)
class Written:
    """What hand-written files of a language look like: the 98th percentile of the longest line, the mean line and the
    numeric literals per word, and the 2nd percentile of the share of blanks."""

    longest: int
    mean: float
    numbers: float
    blanks: float


# Measured on hand-written files of the test tables (5,503 files of scale 0.1, less those that are not).
WRITTEN = {
    "python": Written(117, 44.6, 0.13, 0.175),
    "typescript": Written(140, 43.4, 0.14, 0.152),
    "go": Written(123, 31.6, 0.15, 0.139),
    "rust": Written(122, 42.9, 0.12, 0.160),
    "java": Written(129, 39.9, 0.11, 0.219),
}


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language: how far beyond what is hand-written a file has to lie."""

    longest: float  # minified: longest line at least this
    mean: float  # and mean line length at least this
    blanks: float  # or a longest line as above and at most this share of blanks
    numbers: float  # data: numeric literals per word at least this
    encoded: float = 0.45  # data: share of characters in long encoded runs at least this; hand-written files have none
    alnum: float = 0.80  # data: alphanumeric share at least this, with encoded runs
    statements: int = 3  # data: at most so many statements
    literals: int = 12  # numbers as data: so many at least; a few constants are no table
    repeated: float = 0.10  # generated: share of lines that are like ALIKE others but for numbers; hand-written at most 0.02
    lines: int = 10  # of so many at least

    @staticmethod
    def beyond(w: Written) -> Layout:
        return Layout(3 * w.longest, 2.5 * w.mean, w.blanks / 2, 3 * w.numbers)


LAYOUTS = {language: Layout.beyond(w) for language, w in WRITTEN.items()}
OTHERWISE = LAYOUTS["typescript"]  # other languages: the widest lines
EXTENSIONS = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "go": "go", "rs": "rust", "java": "java"}

MARK = r"(?im)^[\s\uFEFF]*(?://+!?|/\*+!?|#+!?|\*+|<!--|--|;+|\"{3}|'{3})[ \t]*"
# What tools write at the start of a comment on top (or at the end) of what they emit.
GENERATED = MARK + (
    r"(?:@generated\b|</?auto-?generated|code generated (?:by|from)\b|auto(?:matically)?[- ]?generated (?:file|code|by|from|using|with)\b|(?:this (?:file|code|module) (?:is|was|has been) |file )?(?:auto[- ]?|automatically )?generated (?:automatically )?(?:by|from|with|using) (?:the )?[\w.-]+"
    r"|machine[- ](?:written|generated|made)\b|(?:this file (?:is|was) )?(?:created|written|produced|emitted) automatically\b|(?:diese datei wurde|dieser code wurde|datei) automatisch\b|automatisch (?:erzeugt|generiert)|(?:fichier|code) g.n.r. automatiquement|g.n.r. automatiquement"
    r"|(?:archivo|fichero|c.digo) generado autom.ticamente|generado autom.ticamente|(?:本文件|此文件)?.{0,6}自动生成|.{0,12}自動生成)"
)
GENERATED_PATH = r"(?i)(?:^|/)(?:__generated__|generated|generated-src|generated_sources|autogenerated)/|(?:^|/)zz_generated\.[^/]*$|(?:_pb2(?:_grpc)?\.pyi?|_pb\.[a-z]+|\.pb(?:\.gw)?\.go|_grpc\.pb\.[a-z]+|\.g\.[a-z]+|\.gen\.[a-z]+|[._-](?:auto)?generated\.[a-z]+|_gen\.[a-z]+|OuterClass\.java)$"
# Helpers that compilers and bundlers put into their output.
COMPILED = r"\b__awaiter\s*=\s*\(this|\b__esModule\"\s*,\s*\{\s*value|\b__webpack_(?:require|modules)__|\b__extends\s*=\s*\(this|\bparcelRequire\b|\b_interopRequireDefault\s*\("
MINIFIED_PATH = r"(?i)[.-]min\.[cm]?js$"
STATEMENT = r"(?m)^\s*(?:return\b|if\b|for\b|while\b|def\b|fn\b|func\b|function\b|async\b|export\s+(?:async\s+)?function\b|pub\s|let\s+\w+\s*=|try\b|with\b|throw\b|raise\b|switch\b|match\b|impl\b|import\b|use\b|log\.|console\.|(?:public|private|protected)\s[^={]*\(|\w+\([^()]*\);?\s*$)"
NUMBER = r"(?<![\w.])[-+]?(?:0[xX][0-9A-Fa-f]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?!\w)"
ENCODED = r"[A-Za-z0-9+/=_-]{40,}"

THIRD_PARTY_DIR = r"(?i)(?:^|/)(?:vendor|vendors|vendored|_vendor|third[-_]?party|node_modules|bower_components|jspm_packages|externs?|externals?|site-packages|dist-packages)/"
LIBRARY_OF_PATH = r"(?i)(?:^|/)(?:vendor|vendors|vendored|_vendor|third[-_]?party|node_modules|bower_components|jspm_packages|externs?|externals?|site-packages|dist-packages)/(?:[\w-]+(?:\.[\w-]+)+/)?(?:@[\w.-]+/)?([\w.-]+?)/"
_LIB = r"(?:lib\.|com\.|org\.)?([\w.-]*\w)"
# Banners that only libraries carry; the group is the library's name.
LIBRARY_BANNERS = (
    MARK + rf"(?:vendored|(?:imported|copied|taken|included) (?:unchanged|unmodified|verbatim|as is)) from (?:the )?{_LIB}\b",
    MARK + rf"{_LIB} v?\d+\.\d+[\w.-]*\s*\|\s*(?:\(c\)|copyright|©)",
    MARK + rf"{_LIB} - an? [\w -]*library\s*$",
    MARK + rf"upstream(?: project| source| repository)?:\s*{_LIB}",
    MARK + rf"spdx-filecopyrighttext:\s*(?:\d{{4}}\s+)?(?:the )?{_LIB} (?:contributors|authors|developers)",
    MARK + rf"this file is part of (?:the )?{_LIB}\.\s*$",
)
# A banner that own code carries too; it counts where the named owner is a known library.
OWNER_BANNER = MARK + rf"(?:\(c\)|copyright)(?: \(c\))?(?: \d{{4}}(?:-\d{{4}})?)?(?: by)? (?:the )?{_LIB} (?:contributors|authors|developers)"

# Words without which none of the patterns above can match; looked for first, as plain substrings of the lower-cased text.
GENERATED_HINTS = ("generat", "automat", "machine", "généré", "genere", "g\u00e9n", "自动", "自動", "autom\u00e1t", "created", "produced", "emitted", "written")
# One set for each of LIBRARY_BANNERS; each set needs one of its words.
BANNER_HINTS = (
    (("vendored from", "unchanged from", "unmodified from", "verbatim from", "as is from"),),
    (("|",), ("(c)", "copyright", "©")),
    ((" - a",), ("library",)),
    (("upstream",),),
    (("spdx-filecopyrighttext",),),
    (("this file is part of",),),
)
OWNER_HINTS = ((" contributors", " authors", " developers"), ("copyright", "(c)"))
COMPILED_HINTS = ("__", "parcelRequire", "_interop")

COPY_SHARE = 0.6  # of a file's distinct long lines; own code stays near a quarter, copies near all
LONG_LINE = 25
REPEATED_LINE = 12  # characters, numbers aside
ALIKE = 7
COMMENTS = ("//", "#", "*", "/*")
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"


def _language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = F.lit(None).cast("string")
    for language in LAYOUTS:
        out = F.when(ext.isin(*[e for e, name in EXTENSIONS.items() if name == language]), language).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def layout(text: Column) -> tuple[dict[str, Column], ...]:
    """Statistics of a text whose line ends are \\n, in the order in which they build on each other. The costly ones are
    taken only where the result still hangs on them, else they are null: statements are counted up to one more than data may
    have, numbers only where there are no more and any digit is present."""
    n = F.greatest(F.length(text), F.lit(1))
    most, least = max(x.statements for x in LAYOUTS.values()), min(x.literals for x in LAYOUTS.values())
    # a drawing kept in one string or comment is no table of numbers, nor is its line minified
    bare = F.regexp_replace(text, r"(?m)^[^\"\n]{0,80}\"[^\"\n]{100,}\"[^\"\n]{0,10}$|^[ \t]*(?://|#).*$", "")
    lengths = F.transform(F.split(F.col("bare"), "\n"), lambda x: F.length(x))
    return {"bare": bare}, {
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "mean": F.length("bare") / F.greatest(F.size(F.filter(lengths, lambda k: k > 0)), F.lit(1)),
        "blanks": (n - F.length(F.translate(text, " \t\n\f\u00a0", ""))) / n,
        "digits": (n - F.length(F.translate(text, "0123456789", ""))) / n,
        "encoded": _share(text, ENCODED),
        "statements": F.size(F.split(text, STATEMENT, most + 2)) - 1,
    }, {
        "literals": F.when((F.col("digits") > 0) & (F.col("statements") <= most), F.regexp_count("bare", F.lit(NUMBER))),
        "alnum": F.when(F.col("encoded") > 0, _share(text, r"[A-Za-z0-9]+")),
    }, {
        "numbers": F.when(F.col("literals") >= least, F.col("literals") / F.greatest(F.regexp_count("bare", F.lit(r"\w+(?:\.\d+)?")), F.lit(1))),
    }


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _each(text: Column, sets: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(True)
    for parts in sets:
        out = out & _any(text, parts)
    return out


def _any_start(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.startswith(p)
    return out


def _by_language(rule) -> Column:
    out = rule(OTHERWISE)
    for language, limits in LAYOUTS.items():
        out = F.when(F.col("language") == language, rule(limits)).otherwise(out)
    return out


def judged(documents: DataFrame) -> DataFrame:
    """Documents with a repo and path, with what text and path alone tell: `doc_id, repo, path, language`, the layout
    statistics, `generated`, `minified`, `data`, `packed` and `repeated` (minified and generated by layout alone), `third_party`, `library`, `owner`, and `lines`, hashes of the distinct
    long lines, and `whole`, a hash of all lines but imports and comments (null without any). Null and empty texts are judged by path."""
    d = documents.select("doc_id", "repo", plain_path(F.col("path")).alias("path"), F.coalesce("text", F.lit("")).alias("text")).where(~blank(F.col("path")) & F.col("repo").isNotNull())
    d = d.withColumn("text", F.translate(F.regexp_replace("text", "\r\n?|[\u2028\u2029]", "\n"), INVISIBLE, "")).withColumn("language", _language(F.col("path")))
    t = F.col("text")
    d = d.withColumn("low", F.lower(t))
    for statistics in layout(t):
        d = d.withColumns(statistics)
    path_library = F.nullif(F.regexp_extract("path", LIBRARY_OF_PATH, 1), F.lit(""))
    low = F.col("low")
    banner = F.coalesce(*[F.when(_each(low, hints), F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for p, hints in zip(LIBRARY_BANNERS, BANNER_HINTS, strict=True)])
    owner = F.when(_each(low, OWNER_HINTS), F.nullif(F.regexp_extract(t, OWNER_BANNER, 1), F.lit("")))
    generated = _any(low, GENERATED_HINTS) & t.rlike(GENERATED)
    data = F.coalesce(_by_language(lambda x: ((F.col("numbers") >= x.numbers) & (F.col("literals") >= x.literals) | (F.col("encoded") >= x.encoded) & (F.col("alnum") >= x.alnum)) & (F.col("statements") <= x.statements)), F.lit(False))
    minified = _by_language(lambda x: (F.col("longest") >= x.longest) & ((F.col("mean") >= x.mean) | (F.col("blanks") <= x.blanks)))
    # accessors and tables written out by a tool repeat their lines but for numbers
    squeezed = F.split(F.regexp_replace(t, "[ \t]+", " "), "\n ?")
    numberless = F.sort_array(F.filter(F.transform(F.array_distinct(squeezed), lambda x: F.translate(x, "0123456789", "")), lambda x: (F.length(x) >= REPEATED_LINE) & ~_any_start(x, COMMENTS)))
    alike = F.size(F.filter(F.zip_with("numberless", F.slice("numberless", F.lit(ALIKE + 1), F.greatest(F.size("numberless"), F.lit(1))), lambda a, b: a == b), lambda x: x))
    d = d.withColumn("numberless", numberless).withColumn("alike", alike)
    repeated = _by_language(lambda x: (F.size("numberless") >= x.lines) & (F.col("alike") >= F.size("numberless") * x.repeated))
    no_text = ("import ", "from ", "use ", "package ", *COMMENTS)
    long_lines = F.filter(squeezed, lambda x: (F.length(x) > LONG_LINE) & ~_any_start(x, no_text))
    body = F.filter(F.transform(squeezed, lambda x: F.trim(x)), lambda x: (x != "") & ~_any_start(x, no_text))
    return d.select(
        "doc_id", "repo", "path", "language", "longest", "mean", "blanks", "digits", "alnum", "numbers", "encoded", "statements",
        (F.col("path").rlike(GENERATED_PATH) | generated | _any(t, COMPILED_HINTS) & t.rlike(COMPILED)).alias("generated"),
        (minified & ~data | F.col("path").rlike(MINIFIED_PATH)).alias("minified"),
        data.alias("data"),
        (minified & ~data).alias("packed"),
        (repeated & ~data).alias("repeated"),
        (F.col("path").rlike(THIRD_PARTY_DIR) | banner.isNotNull()).alias("third_party"),
        F.lower(F.coalesce(banner, path_library)).alias("library"),
        F.lower(owner).alias("owner"),
        F.array_distinct(F.transform(long_lines, lambda x: F.xxhash64(x))).alias("lines"),
        F.when(F.size(body) > 0, F.xxhash64(F.array_join(body, "\n"))).alias("whole"),
    )


def machine_made(documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`repo, path, reason, evidence`, one row a file: data, minified, generated, vendored or copied (the first that
    applies). The evidence is layout where that suffices, convention (names, folders, banners, helpers of compilers) or
    content (of a library).

    A file is judged by all its documents. With `files`, only files listed there (in plain form) count. Documents
    without repo or path are left out; repeated rows and rows collected again make no difference; empty tables give no
    rows."""
    from cambium.session import cut

    # the statistics are needed by three joins; written once, without the text
    all_ = cut(judged(documents), "judged")
    names = all_.where("third_party and library is not null").select(F.col("library").alias("owner")).distinct()
    owned = all_.where("not third_party and owner is not null").join(names, "owner", "left_semi").select("doc_id", F.lit(True).alias("by_owner")).distinct()
    known = all_.join(owned, "doc_id", "left").withColumn("third_party", F.col("third_party") | F.coalesce("by_owner", F.lit(False)))
    plain = ~(F.col("generated") | F.col("minified") | F.col("data"))
    # a library without folder or banner goes by its file's name, the same for all files of the same content
    libraries = known.where(F.col("third_party") & plain).select("lines", "whole", F.coalesce("library", "owner").alias("named"), F.lower(F.regexp_extract("path", r"[^/]+$", 0)).alias("file"))
    same = libraries.where("named is null and whole is not null").groupBy("whole").agg(F.min("file").alias("first"))
    libraries = libraries.join(same, "whole", "left").select("lines", "whole", F.coalesce("named", "first", "file").alias("lib"))
    of_libraries = libraries.select(F.explode("lines").alias("line"), "lib")
    # files of a library's content, of any length; without long lines only of one library, else it is a common idiom
    wholes = libraries.where("whole is not null").groupBy("whole").agg(F.min("lib").alias("lib"), F.max("lib").alias("other"), F.max(F.size("lines")).alias("n")).where("n > 0 or lib = other").select("whole")
    same_whole = known.where(~F.col("third_party") & plain).join(wholes, "whole", "left_semi").select("doc_id", F.lit(True).alias("copied"))
    # lines of exactly one library: common idioms drop out, and a line matches at most one row
    telling = of_libraries.groupBy("line").agg(F.min("lib").alias("lib"), F.max("lib").alias("other")).where("lib = other").select("line", "lib")
    rest = known.where(~F.col("third_party") & plain & (F.size("lines") >= 3)).select("doc_id", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    copied = rest.join(telling, "line").groupBy("doc_id", "lib").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where(F.col("hits") >= F.col("n") * COPY_SHARE).select("doc_id", F.lit(True).alias("copied")).unionByName(same_whole).distinct()
    told = F.when(F.col("repeated"), "layout").otherwise("convention")
    order = [("data", "data", F.lit("layout")), ("packed", "minified", F.lit("layout")), ("generated", "generated", told), ("minified", "minified", F.lit("convention")), ("third_party", "vendored", F.lit("convention")), ("repeated", "generated", told), ("copied", "copied", F.lit("content"))]
    reason = F.lit(None)
    for k, (flag, name, evidence) in reversed(list(enumerate(order))):
        reason = F.when(F.col(flag), F.struct(F.lit(k).alias("order"), F.lit(name).alias("reason"), evidence.alias("evidence"))).otherwise(reason)
    found = known.join(copied, "doc_id", "left").select("repo", "path", reason.alias("r")).where("r is not null").groupBy("repo", "path").agg(F.min("r").alias("r")).select("repo", "path", "r.reason", "r.evidence")
    if files is None:
        return found
    listed = files.select("repo", plain_path(F.col("path")).alias("path")).distinct()
    return found.join(listed, ["repo", "path"], "left_semi")


def hand_written(documents: DataFrame) -> DataFrame:
    """The rows of documents with a path that `machine_made` leaves: only hand-written source."""
    rest = documents.where(F.col("path").isNotNull()).withColumns({"_r": F.col("repo"), "_p": plain_path(F.col("path"))})
    out = machine_made(documents).select(F.col("repo").alias("_r"), F.col("path").alias("_p"))
    return rest.join(out, ["_r", "_p"], "left_anti").drop("_r", "_p")
