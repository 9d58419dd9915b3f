"""Language and file type of a text, by extension and by content rules, as built-in expressions (JSON validity too)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Languages by extension.
EXTENSIONS = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".mts", ".cts"),
    "tsx": (".tsx",),
    "python": (".py", ".pyw", ".pyi"),
    "json": (".json", ".jsonc"),
    "html": (".html", ".htm", ".xhtml"),
    "css": (".css", ".scss", ".sass", ".less"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "yaml": (".yml", ".yaml"),
    "bash": (".sh", ".bash", ".zsh", ".fish"),
    "regex": (".regex", ".regexp"),
}
#: Patterns of a language, of which two must occur, in the order of the tests.
RULES = {
    "bash": [r"^\s*(if|then|else|elif|fi)\s*$", r"^\s*(for|while|do|done)\s*$", r"^\s*echo\s+", r"\$\w+", r"\$\{\w+\}", r"^\s*export\s+\w+="],
    "python": [r"^\s*def\s+\w+\s*\(", r"^\s*class\s+\w+.*:", r"^\s*import\s+(?!java\b)\w", r"^\s*from\s+\w+\s+import", r"^\s*if __name__\s*==\s*['\"]__main__['\"]\s*:", r"^\s*async def", r"^\s*(try|except|finally|raise)\s*:", r"^\s*print\s*\(", r"^\s*#.*$"],
    "go": [r"^\s*package\s+\w+", r"^\s*func\s+\w+", r"^\s*import\s*\(", r"\bdefer\s+", r"\bgo\s+\w+\(", r"\bchan\s+"],
    "rust": [r"\bfn\s+\w+\s*\(", r"\blet\s+mut\s+", r"\bimpl\s+", r"\buse\s+\w+::", r"\bmod\s+\w+", r"\bpub\s+(fn|struct|enum|trait)", r"\bmatch\s+"],
    "java": [r"\bpublic\s+class\s+\w+", r"\bprivate\s+\w+\s+\w+\s*;", r"\bSystem\.(out|err)\.", r"\bimport\s+java\.", r"@\w+\s*$"],
    "yaml": [r"^---\s*$", r"^\w+:\s*\w", r"^\s+-\s+\w", r"^\w+:\s*$"],
    "html": [r"(?i)<(!DOCTYPE|html|head|body|div|span|p|a|img)\b", r"(?i)<\w+\s+\w+\s*=\s*[\"'][^\"']*[\"']", r"(?i)</\w+>"],
}
#: Patterns of JavaScript, of TypeScript and what it needs besides, what JavaScript doesn't have, and the first line of a shell script.
JAVASCRIPT = [r"\b(const|let|var)\s+[\w_$]+\s*[=:]", r"\bfunction\s+[\w_$]+\s*\(", r"\bclass\s+[\w_$]+\s*\{", r"\b(import|export)\s+\{", r"\basync\s+function\b", r"\bawait\s+", r"=>", r"\bconsole\.(log|error|warn|info)\b", r"\bdocument\.\w+\("]
TYPESCRIPT = [r":\s*(string|number|boolean|any|void|never)\s*[=;)]", r"\binterface\s+\w+\s*\{", r"\btype\s+\w+\s*=", r"\b(enum|namespace|module)\s+\w+", r"<\w+(,\s*\w+)*>"]
TYPESCRIPT_BASE = [r"\b(const|let|var)\s+", r"\bfunction\s+", r"\b(import|export)\b"]
NOT_JAVASCRIPT = [r"\bpublic\s+class\b", r"\bprivate\s+\w+\s+\w+;", r"\bSystem\.(out|err)\.", r"\bimport\s+java\.", r":\s*(string|number|boolean|any|void|never)\s*[=;)]", r"\binterface\s+\w+\s*\{", r"\btype\s+\w+\s*=", r"\benum\s+\w+"]
SHEBANG = r"^#!/bin/(bash|sh|zsh|dash)"
#: File types by extension, and patterns of network configurations.
FILE_TYPES = {
    "python": ("py",),
    "javascript": ("js",),
    "typescript": ("ts",),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "xml": ("xml",),
    "html": ("html",),
    "css": ("css",),
    "go": ("go",),
    "rust": ("rs",),
    "java": ("java",),
    "c": ("c",),
    "cpp": ("cpp",),
    "bash": ("sh", "bash"),
    "markdown": ("md",),
    "text": ("txt",),
}
IOS = [r"^\s*!", r"^interface\s+", r"^hostname\s+", r"^line\s+(console|vty)", r"^router\s+", r"^version\s+\d+\.\d+"]
JUNOS = [r"^set\s+", r"^system\s*\{", r"^interfaces\s*\{", r"^routing-options\s*\{", r"^(edit|configure)\s+", r"^show\s+(configuration|interfaces)"]


def _hits(c: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + c.rlike("(?m)" + p).cast("int")
    return out


def extension(name: Column) -> Column:
    """With its dot, lower-cased; test and spec files count as their language, declarations (.d.ts) as themselves; none without a dot or if it is the first character."""
    low = F.lower(name)
    last = F.regexp_extract(low, r"^(?s).+(\.[^.]*)$", 1)
    return F.when(low.endswith(".d.ts"), ".d.ts").when(last != "", last)


def language_by_extension(name: Column) -> Column:
    ext = extension(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for language, names in EXTENSIONS.items():
        out = out.when(ext.isin(*names), language)
    return out


def is_json(c: Column) -> Column:
    t = trimmed(c)
    return (t.startswith("{") | t.startswith("[")) & F.coalesce(F.try_parse_json(t).isNotNull(), F.lit(False))


def language_by_content(c: Column) -> Column:
    """The first language whose rule fits: JSON by validity, TypeScript by one pattern of its own and one of JavaScript, the others by two patterns."""
    python = c.rlike(r"^\s*def\s+\w+") | (c.rlike(r"(?m)^\s*@[\w_]+") & c.rlike(r"(?m)^\s*async def"))
    rust = c.rlike(r"\bfn\s+\w+\s*\(") & (c.rlike(r"\bmod\s+\w+") | c.rlike(r"\buse\s+\w+::") | c.rlike(r"\bimpl\s+"))
    out = F.when(is_json(c), "json").when((_hits(c, TYPESCRIPT_BASE) >= 1) & (_hits(c, TYPESCRIPT) >= 1), "typescript")
    out = out.when((_hits(c, JAVASCRIPT) >= 2) & (_hits(c, NOT_JAVASCRIPT) == 0) & ~python & ~rust, "javascript")
    for language, patterns in RULES.items():
        fits = _hits(c, patterns) >= 2
        out = out.when(fits | c.rlike("(?m)" + SHEBANG) if language == "bash" else fits, language)
    return out


def supported_extensions() -> list[tuple[str, str]]:
    """Language and extension, in the order of the table."""
    return [(k, x) for k, names in EXTENSIONS.items() for x in names]


def detection_details(name: Column, content: Column) -> Column:
    """Extension, the languages by extension and by content, the one that is taken, and whether there is one."""
    a, b = language_by_extension(name), language_by_content(content)
    return F.struct(extension(name).alias("extension"), a.alias("extension_language"), b.alias("content_language"), F.coalesce(a, b).alias("final_language"), F.coalesce(a, b).isNotNull().alias("supported"))


def detect_language(name: Column, content: Column) -> Column:
    return F.coalesce(language_by_extension(name), language_by_content(content))


def common_language(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """Of two versions: the one that both, or one of them, have; of different ones javascript if a text uses console. or document. ."""
    x, y = detect_language(name_a, a), detect_language(name_b, b)
    script = F.concat(F.coalesce(a, F.lit("")), F.lit("\n"), F.coalesce(b, F.lit(""))).rlike(r"(console|document)\.")
    return F.when(x == y, x).when(x.isNull() | y.isNull(), F.coalesce(x, y)).when(script, "javascript")


def file_type(content: Column, name: Column | None = None) -> Column:
    """By extension, else network configurations, JSON, XML and YAML by their looks, else text."""
    head, t = F.substring(content, 1, 5000), trimmed(content)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if name is not None:
        ext = F.lower(F.substring_index(name, ".", -1))
        for kind, names in FILE_TYPES.items():
            out = out.when(ext.isin(*names), kind)
    ends = lambda a, b: t.startswith(a) & t.endswith(b)
    first = F.array_join(F.slice(F.split(content, "\n", -1), 1, 50), "\n")
    return (
        out.when(_hits(head, IOS) >= 1, "cisco-ios").when(_hits(head, JUNOS) >= 2, "juniper-junos").when(ends("{", "}") | ends("[", "]"), "json")
        .when(t.startswith("<?xml") | t.startswith("<!DOCTYPE") | t.rlike(r"^<[a-zA-Z][\s\S]*?>"), "xml")
        .when(first.rlike(r"(?m)^---|^[a-zA-Z_][a-zA-Z0-9_]*\s*:|^\s*-\s+"), "yaml").otherwise("text")
    )
