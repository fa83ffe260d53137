"""Column functions over text: tokens, tags, annotations, sanitizing, redaction.

All but ``signature`` are built-in expressions (no Python workers).  Character limits count code
points.  Nulls give nulls, or empty arrays where an array is returned.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import bound

# Words that mark technical topics
TOPIC_WORDS = (
    "stripe payment session checkout purchase auth authentication login register middleware database connection pool config service "
    "controller model repository test api customer user admin notification email validation request response http route"
).split()
# Call-like keywords that are not calls
NOT_CALLS = "if for while switch catch return function class new await yield isset empty echo print require include".split()
# Secret formats
SECRETS = (
    r"sk-[a-zA-Z0-9]{16,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"xox[baprs]-[A-Za-z0-9-]{12,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}",
    r"(?i)Bearer\s+[A-Za-z0-9._-]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?)-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)(?:api|secret|token|password)[\s:=]+[A-Za-z0-9._-]{8,}",
)
# Forms of complex questions; word edges are ASCII
COMPLEX = (
    r"\bhow\s+(does|do|can|should)\b", r"\bwhat\s+(is|are|does)\b", r"\bexplain\b", r"\bwalk\s+me\s+through\b", r"\bstep\s+by\s+step\b",
    r"\band\b.*\band\b", r"\bor\b.*\bor\b", r"\?.*\?",
)
# Forms of variables worth keeping
IMPORTANT = (
    r"(?i)const\s+\w*(config|setting|option|endpoint|url|key|secret|token)\w*",
    r"(?i)const\s+\w*(api|service|client|provider)\w*",
    r"const\s+[A-Z_]{3,}",
    r"export\s+const",
    r"static\s+(final\s+)?[A-Z_]+",
)
# Comment forms by language; languages not listed have none
COMMENTS = {
    "php": r"/\*\*[\s\S]*?\*/", "python": r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''", "javascript": r"/\*\*[\s\S]*?\*/", "tsx": r"/\*\*[\s\S]*?\*/", "typescript": r"/\*\*[\s\S]*?\*/",
    "go": r"/\*[\s\S]*?\*/", "java": r"/\*\*[\s\S]*?\*/", "csharp": r"/\*\*[\s\S]*?\*/", "rust": r"///.*|/\*\*[\s\S]*?\*/", "ruby": r"(?m)#.*$", "cpp": r"/\*[\s\S]*?\*/", "c": r"/\*[\s\S]*?\*/",
    "scala": r"/\*\*[\s\S]*?\*/", "swift": r"/\*\*[\s\S]*?\*/", "bash": r"(?m)#.*$", "kotlin": r"/\*\*[\s\S]*?\*/", "lua": r"(?m)--.*$", "html": r"<!--[\s\S]*?-->", "css": r"/\*[\s\S]*?\*/",
    "ocaml": r"\(\*[\s\S]*?\*\)", "haskell": r"(?m)--.*$", "elixir": r"(?m)#.*$", "markdown": r"<!--[\s\S]*?-->",
}
# Names of environment variables and parts of keys whose values are secret
ENV_NAMES = "OPENAI_API_KEY NPM_TOKEN GITHUB_TOKEN GH_TOKEN DATABASE_URL SUPABASE_ANON_KEY SUPABASE_SERVICE_ROLE_KEY".split()
SENSITIVE_WORDS = "token secret password passwd pwd authorization auth bearer session cookie apikey clientsecret".split()
SENSITIVE_PAIRS = (("api", "key"), ("client", "secret"), ("access", "token"), ("refresh", "token"))
# Signs of a reply that follows or leaks instructions
LEAKS = r"(?i)</?(code_context|user_query)>"
OBEYS = r"(?i)system prompt|ignore previous instructions"
# Forms of names, tried in this order
NAME_FORMS = (
    r"(?:public|private|protected)?\s*(?:static)?\s*function\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"function\s+([a-zA-Z_][a-zA-Z0-9_]*)",
    r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^)]*\)\s*\{",
    r"class\s+([a-zA-Z_][a-zA-Z0-9_]*)",
)
CALL = r"(?:\$?[A-Za-z_][\w]*->|[A-Za-z_][\w]*::|[A-Za-z_][\w]*\.)*([A-Za-z_][\w]*)\s*\("
RETURNS = (r":\s*([A-Za-z0-9_\\\[\]<>|?]+)", r"->\s*([A-Za-z0-9_\\\[\]<>|?]+)")
SNIPPET, CALL_SNIPPET, RETURN_SNIPPET, PARAMETERS = 400, 120, 80, 12
ROLES = ("system", "assistant", "developer", "user")
ZERO_WIDTH = "​"
MARK = "[REDACTED]"


def ascii_edges(pattern: str) -> str:
    r"""``\b`` as an edge of ASCII words, which is what the patterns mean."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(q)), "[¿?]", ""), r"\s+", " ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(parts, lambda x: x != "")


def symbol_words(symbol: Column) -> Column:
    """Words of an identifier: camel case, underscores and other marks separate."""
    plain = F.regexp_replace(F.coalesce(symbol, F.lit("")), "[^A-Za-z0-9_]", " ")
    cut = F.regexp_replace(plain, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), "[ _]+"), lambda x: x != "")


def _tag_words(name: Column) -> Column:
    words = F.split(F.lower(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")), r"[\s_-]+")
    return F.filter(words, lambda x: F.length(x) > 2)


def semantic_tags(path: Column, symbol: Column, code: Column, limit: int = 10) -> Column:
    """Words of path, symbol, topics and declared names, in that order, without repeats.

    The text is lower-cased once and searched for declarations twice (kinds and names), whatever the number of words.
    """
    empty, kinds = F.lit(""), ("class", "function", "const", "interface", "trait")
    parts = F.transform(F.split(F.coalesce(path, empty), "/"), lambda p: F.regexp_replace(p, r"\.(php|js|ts|tsx)$", ""))
    topics = bound(F.lower(F.coalesce(code, empty)), lambda low: F.filter(F.array(*map(F.lit, TOPIC_WORDS)), lambda w: F.contains(low, w)))
    form = F.lit(rf"(?i)({'|'.join(kinds)})(?=\s+(\w+))")
    found = F.arrays_zip(F.transform(F.regexp_extract_all(F.coalesce(code, empty), form, F.lit(1)), F.lower).alias("kind"), F.regexp_extract_all(F.coalesce(code, empty), form, F.lit(2)).alias("name"))
    declared = bound(found, lambda all_: F.flatten(F.transform(F.array(*map(F.lit, kinds)), lambda k: F.flatten(F.transform(F.filter(all_, lambda x: x["kind"] == k), lambda x: _tag_words(x["name"]))))))
    return F.slice(F.array_distinct(F.concat(F.flatten(F.transform(parts, _tag_words)), _tag_words(F.coalesce(symbol, empty)), topics, declared)), 1, limit)


def annotation(comment: Column, name: str, prefix: str = "@trawl") -> Column:
    """The value of a line ``<prefix>-<name>: value``; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(comment, F.lit("")), rf"(?m){prefix}-{name}:[ \t]*(.+)$", 1)), F.lit(""))


def annotation_tags(comment: Column, prefix: str = "@trawl") -> Column:
    return F.when(annotation(comment, "tags", prefix).isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.split(annotation(comment, "tags", prefix), ","), lambda x: F.trim(x)))


def merged_tags(own: Column, automatic: Column) -> Column:
    return F.array_union(own, automatic)


def is_important_variable(code: Column) -> Column:
    return reduce(lambda a, b: a | b, [code.rlike(p) for p in IMPORTANT])


def variables(code: Column) -> Column:
    """(name, value) of each important declaration of the code, in order; values are cut at 100 characters."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?m)^[ \t]*((?:export[ \t]+)?(?:(?:public|private|protected)[ \t]+)?(?:const|let|var|static|final)\b[^\n;]*)"), F.lit(1))
    name = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\s*(?::[^=\n]*)?=", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"([A-Za-z_$][\w$]*)\s*$", 1), F.lit("")), F.lit("unknown"))
    value = lambda x: F.when(F.length(x) > 100, F.concat(F.substring(x, 1, 100), F.lit("..."))).otherwise(x)
    return F.transform(F.filter(found, is_important_variable), lambda x: F.struct(name(x).alias("name"), value(x).alias("value")))


def call_names(code: Column) -> Column:
    """Distinct names before an opening parenthesis, without keywords."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, NOT_CALLS)))


def call_name(snippet: Column) -> Column:
    """The function that a call's text names, after any receivers; null for keywords and other text."""
    name = F.regexp_extract(F.trim(F.substring(snippet, 1, CALL_SNIPPET)), CALL, 1)
    return F.when((name != "") & ~name.isin(NOT_CALLS), name)


def symbol_name(code: Column, kind: Column, start: Column) -> Column:
    """What a piece of code declares, by its form; else its kind and place."""
    forms = [F.nullif(F.regexp_extract(code, form, 1), F.lit("")) for form in NAME_FORMS]
    return F.coalesce(*forms, F.concat(kind, F.lit("_"), start.cast("string")))


def signature(symbol: Column, code: Column, kind: Column) -> Column:
    """(signature, parameters, returns) of a declaration, read from the first characters of its code.

    Parentheses nest, so no pattern finds a parameter list: a small function over Arrow batches does.
    """

    @F.pandas_udf("signature string, parameters array<string>, returns string")
    def read(symbols: pd.Series, snippets: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        rows = []
        for name, text, kind_ in zip(symbols.fillna(""), snippets.fillna(""), kinds.fillna("")):
            name = name.strip()
            if "class" in kind_ and name or not name:
                rows.append((f"class {name}" if name else "", [], None))
                continue
            parameters, after = parameter_list(text)
            found = [m for p in RETURNS if (m := re.search(p, after))]
            returns = found[0][1] if found else None
            rows.append((f"{name}({', '.join(parameters)})" + (f" : {returns}" if returns else ""), parameters, returns))
        return pd.DataFrame(rows, columns=["signature", "parameters", "returns"])

    return read(symbol, F.substring(code, 1, SNIPPET), kind)


def parameter_list(text: str) -> tuple[list[str], str]:
    """(names of the first parameters without defaults and leading marks, the text after the list)."""
    begin, depth = text.find("("), 0
    for i in range(max(begin, 0), len(text) if begin >= 0 else 0):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            names = [part.split("=")[0].strip().lstrip("*&").strip() for part in text[begin + 1 : i].split(",")]
            return [x for x in names if x][:PARAMETERS], text[i + 1 : i + RETURN_SNIPPET]
    return [], ""


def names_symbol(query: Column, symbol: Column, signature: Column, parameters: Column, keywords: Column) -> Column:
    """Does a query name a symbol: whole, by signature, by a parameter of 3 or more characters, or by the start of a word?"""
    q, none = F.lower(query), F.array().cast("array<string>")
    whole = lambda x: F.coalesce((x != "") & F.contains(q, F.lower(x)), F.lit(False))
    by_parameter = F.exists(F.coalesce(parameters, none), lambda p: F.coalesce((F.length(p) > 2) & F.contains(q, F.lower(p)), F.lit(False)))
    return whole(symbol) | whole(signature) | by_parameter | F.exists(F.coalesce(keywords, none), lambda w: F.coalesce(has_word_prefix(query, w), F.lit(False)))


def last_comment(before: Column, pattern: str, reach: int = 500) -> Column:
    """The last match of a comment pattern within the final ``reach`` characters."""
    tail = F.substring(before, F.greatest(F.lit(1), F.length(before) - reach + 1), F.lit(reach))
    return F.try_element_at(F.regexp_extract_all(tail, F.lit(pattern), F.lit(0)), F.lit(-1))


def doc_comment(before: Column, lang: Column) -> Column:
    """The last comment of the language's form before a declaration, null if there is none."""
    out = F.lit(None).cast("string")
    for pattern in dict.fromkeys(COMMENTS.values()):
        out = F.when(lang.isin([x for x, p in COMMENTS.items() if p == pattern]), last_comment(before, pattern)).otherwise(out)
    return out


def embedding_text(doc: Column, code: Column, intent: Column, description: Column, tags: Column, variables: Column) -> Column:
    def line(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"// {label}: "), value))

    return F.concat_ws("\n\n", F.nullif(doc, F.lit("")), code, line("Intent", intent), line("Description", description), line("Tags", F.array_join(tags, ", ")), line("Uses variables", F.array_join(variables, ", ")))


def keyword_document(*parts: Column) -> Column:
    """Non-blank parts, one to a line."""
    return F.concat_ws("\n", *[F.when(F.trim(p) != "", p) for p in parts])


def has_word_prefix(query: Column, token: Column) -> Column:
    """Does a word of the query start with ``token`` (ASCII letters and digits, 3 or more)?"""
    word = F.regexp_replace(F.lower(query), "[^a-z0-9_]+", " ")
    return (F.length(token) >= 3) & (F.instr(F.concat(F.lit(" "), word), F.concat(F.lit(" "), F.lower(token))) > 0)


def _neutral(text: Column) -> Column:
    """No control characters, roles marked, markup and fences broken."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for role in ROLES:
        out = F.regexp_replace(out, rf"(?im)^(\s*){role}\s*:", f"$1{role.upper()} (untrusted):")
    out = F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit("```"), F.lit("```" + ZERO_WIDTH)), F.lit("`"), F.lit("`" + ZERO_WIDTH))


def sanitize(text: Column, limit: int = 2000, marker: str = "... [truncated]") -> Column:
    """Untrusted text for a prompt."""
    return bound(F.trim(_neutral(text)), lambda out: F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit(marker))).otherwise(out))


def sanitize_code(code: Column, limit: int = 4000, marker: str = "\n// ... [truncated]") -> Column:
    """Untrusted code for a prompt: its blanks stay."""
    return bound(_neutral(code), lambda out: F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit(marker))).otherwise(out))


def redact(text: Column, env_names: Sequence[str] = ()) -> Column:
    """Text without secrets: values of known environment variables and whatever has the form of a secret.

    Most texts have none: one search for all names and one for all forms tell whether to replace at all.
    """
    names = (*ENV_NAMES, *env_names)
    mark = MARK.replace("[", r"\[").replace("]", r"\]")
    assigned = lambda name: "(?i)" + ascii_edges(r"\b") + name + r"\s*=\s*([^\s;]+)"
    chain = text
    for name in names:
        chain = F.regexp_replace(chain, assigned(re.escape(name)), f"{name}={mark}")
    text = F.when(text.rlike(assigned("(?:" + "|".join(map(re.escape, names)) + ")")), chain).otherwise(text)
    found = text.rlike("|".join(f"(?:{p})" for p in SECRETS))
    return F.when(found, reduce(lambda c, p: F.regexp_replace(c, p, mark), SECRETS, text)).otherwise(text)


def is_sensitive_key(key: Column, more: Sequence[str] = ()) -> Column:
    """Does a key's name say that its value is secret?"""
    cut = F.regexp_replace(F.regexp_replace(key, "([a-z])([A-Z])", "$1_$2"), "[^a-zA-Z0-9]+", "_")
    name = F.lower(F.regexp_replace(cut, "^_+|_+$", ""))
    words = F.split(name, "_")
    pairs = reduce(lambda a, b: a | b, [F.array_contains(words, x) & F.array_contains(words, y) for x, y in SENSITIVE_PAIRS])
    listed = [x.lower() for x in (*ENV_NAMES, *more)]
    return name.isin(listed) | pairs | F.arrays_overlap(words, F.array(*map(F.lit, SENSITIVE_WORDS)))


def redact_map(values: Column, env_names: Sequence[str] = ()) -> Column:
    """A map<string, string> with the values of sensitive keys replaced and the others redacted."""
    return F.transform_values(values, lambda k, v: F.when(v.isNull(), v).when(is_sensitive_key(k, env_names), MARK).otherwise(redact(v, env_names)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def truncate(text: Column, max_tokens: int) -> Column:
    return F.substring(text, 1, 4 * max_tokens)


def is_complex_question(q: Column) -> Column:
    return reduce(lambda a, b: a | b, [q.rlike("(?i)" + ascii_edges(p)) for p in COMPLEX])


def query_pattern(q: Column) -> Column:
    """A query with its session, provider, service and controller names generalized."""
    for pattern, name in ((r"\b[\w-]+Session\b", "[SESSION]"), (r"\bstripe\b", "[PAYMENT_PROVIDER]"), (r"\b\w+Service\b", "[SERVICE]"), (r"\b\w+Controller\b", "[CONTROLLER]")):
        q = F.regexp_replace(q, "(?i)" + ascii_edges(pattern), name.replace("[", r"\[").replace("]", r"\]"))
    return F.trim(q)


def sub_queries(response: Column, limit: int = 4) -> Column:
    """The strings of a JSON array inside a reply, trimmed, blanks dropped."""
    found = F.from_json(F.regexp_extract(response, r"(?s)\[.*\]", 0), "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), 1, limit)


def response_issues(reply: Column) -> Column:
    """Names of what is wrong with a reply; empty if nothing."""
    said = F.coalesce(reply, F.lit(""))
    return F.array_compact(F.array(F.when(F.trim(said) == "", "empty_response"), F.when(said.rlike(LEAKS), "prompt_structure_leak"), F.when(said.rlike(OBEYS), "injection_acknowledgment")))


def citations(markdown: Column) -> Column:
    """Targets of links that are not web addresses, first-seen order."""
    found = F.regexp_extract_all(F.coalesce(markdown, F.lit("")), F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))
    return F.array_distinct(F.filter(found, lambda x: ~(x.startswith("http://") | x.startswith("https://"))))


def with_references(markdown: Column) -> Column:
    """The text with a numbered list of what it cites; unchanged if it cites nothing."""
    lines = lambda c: F.array_join(F.transform(c, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". `"), x, F.lit("`\n"))), "")
    gap = F.when(markdown.endswith("\n\n"), "").otherwise("\n\n")
    return bound(citations(markdown), lambda c: F.when(F.size(c) == 0, markdown).otherwise(F.concat(markdown, gap, F.lit("## References\n\nThe following files were referenced in this answer:\n\n"), lines(c))))


def from_json_list(text: Column) -> Column:
    """The strings of a stored JSON array; null where it is none."""
    return F.from_json(text, "array<string>")


def fingerprint(text: Column) -> Column:
    """A quick 64-bit name of a text, for comparing (seed 42)."""
    return F.xxhash64(text).cast("string")


def line_number(text: Column, start: Column) -> Column:
    """The line, from 1, on which the character at ``start`` (from 0) stands."""
    return F.size(F.split(F.substring(text, F.lit(1), start), "\n", -1))


def lines_before(text: Column, start: Column, count: int) -> Column:
    """The last ``count`` whole lines before ``start``."""
    return F.array_join(bound(F.split(F.substring(text, F.lit(1), start), "\n", -1), lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - count), F.least(F.lit(count), F.size(x) - 1))), "\n")


def head(code: Column) -> Column:
    """What stands before a declaration's body."""
    return F.trim(F.substring_index(code, "{", 1))


def complete_part(code: Column) -> Column:
    """The longest start of a cut piece that ends with a block, else a statement, else a line; whole if none does."""
    last = lambda mark: F.length(code) - F.instr(F.reverse(code), mark) + 1
    out = code
    for mark in ("\n", ";", "}"):
        out = F.when(F.instr(code, mark) > 0, F.substring(code, F.lit(1), last(mark))).otherwise(out)
    return out
