"""C# sources: namespace declarations and using directives, by syntax only, as column expressions.

1. A text is cut at the lines that look like directives. A fold over these
   pieces, of which most files have one, evaluates the directives and drops
   inactive pieces; in active ones a single pattern replaces comments and
   literals by blanks. A comment or literal that is still open at a piece's end is carried
   into the next one, where a ``#`` is no directive then.
2. Of what is left a single pattern takes declarations, directives and
   braces. A fold over these keeps the names of the open namespaces.

All of it is evaluated row by row in the JVM; no text meets another.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Interpolated strings that stand in each other's holes; deeper ones are read as plain strings.
NESTING = 3

_BLANK = r"[\s\p{Z}]"
_LETTER = r"[\p{L}\p{N}_]"
_PLAIN = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_CHAR = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_VERBATIM = r'@"[^"]*+(?:""[^"]*+)*+"'


@cache
def _hole(depth: int) -> str:
    """An expression in braces within an interpolated string, with strings and one more pair of braces in it."""
    strings = "|".join([_PLAIN, _CHAR, _VERBATIM, *([_interpolated(depth - 1)] if depth else [])])
    inner = rf"\{{(?:[^{{}}\"'$@]++|{strings}|[$@])*+\}}"
    return rf"\{{(?!\{{)(?:[^{{}}\"'$@]++|{strings}|[$@]|{inner})*+\}}"


@cache
def _interpolated(depth: int) -> str:
    return rf'(?:\$@|@\$)"(?:[^"{{]++|""|\{{\{{|{_hole(depth)})*+"|\$"(?:[^"\\{{\n]++|\\[\s\S]|\{{\{{|{_hole(depth)})*+"'


_STRINGS = "|".join([
    r'\$*+("{3,}+)[\s\S]*?\3"*+',
    _VERBATIM,
    _interpolated(NESTING),
    r'(?:\$@|@\$)"[^"]*+(?:""[^"]*+)*+"',
    # Plain strings and characters end with the line at the latest.
    r'(?!(?:\$@|@\$|@)"|\$*+""")[$@]*+"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?+',
    r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?+",
])
#: What is no code. The groups of ``_KEPT`` are the beginnings of what is still open at the end, and a mark for a literal.
_LITERAL = rf"""(?=[/"'$@])(?://[^\n]*+|/\*[\s\S]*?\*/|(/\*)[\s\S]*+|(?=([$@"']))(?:{_STRINGS})|\$*+("{{3,}}+)[\s\S]*+|((?:\$@|@\$|@)")[\s\S]*+)"""
_KEPT = " $2 $1$4$5"
_OPEN = r'(/\*|@"|"{3,})$'
#: A block of code with up to two levels of blocks in it.
_BLOCK = r"\{[^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+\}"
_STRUCTURE = (
    rf"(?:\A|(?<=[{{}};\]])){_BLANK}*+(?:namespace(?!{_LETTER})[^{{}};]*+[{{;]"
    rf"|(?:global{_BLANK}++)?+using(?!{_LETTER})(?!{_BLANK}*+\()[^{{}};]*+;?+)|{_BLOCK}|[{{}}]"
)
_STATE = "struct<last:struct<stack:array<struct<now:boolean,taken:boolean,outside:boolean>>,symbols:array<string>,mode:string,code:string>,code:array<string>>"
_FOUND = "struct<names:array<string>,others:int,scope:string,namespaces:array<string>,usings:array<string>,global_usings:array<string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is named there. What it gives is copied, so it is kept small."""
    return F.get(F.transform(F.array(value), body), 0)


def holds(condition: Column, symbols: Column) -> Column:
    """A preprocessor condition; what is malformed is false.

    Symbols become 1 and 0 and the operators single characters; then
    operations on digits are replaced by their results, tightest first, until
    one digit is left.
    """
    words = F.regexp_extract_all(condition, F.lit(r"&&|\|\||==|!=|[!()]|[\p{L}\p{N}_]+"), F.lit(0))

    def coded(word: Column) -> Column:
        marks = {"&&": "&", "||": "|", "==": "=", "!=": "~", "!": "!", "(": "(", ")": ")"}
        out = F.when((word == "true") | F.array_contains(symbols, word), "1")
        for mark, code in marks.items():
            out = out.when(word == mark, code)
        return out.otherwise("0")

    def step(text: Column, _: Column) -> Column:
        rules = [
            ("!0", "1"), ("!1", "0"), ("0=0|1=1|0~1|1~0", "1"), ("0=1|1=0|0~0|1~1", "0"),
            ("(?<![=~!])1&1(?![=~])", "1"), ("(?<![=~!])(?:0&[01]|1&0)(?![=~])", "0"),
            ("(?<![=~!&])0\\|0(?![=~&])", "0"), ("(?<![=~!&])(?:1\\|[01]|0\\|1)(?![=~&])", "1"), ("\\(([01])\\)", "$1"),
        ]
        done = text
        for rule, result in rules:
            done = F.regexp_replace(done, rule, result)
        return F.when(F.length(text) > 1, done).otherwise(text)

    text = F.array_join(F.transform(words, coded), "")
    # Every step shortens a text that is not malformed.
    return F.aggregate(F.sequence(F.lit(0), F.length(text)), text, step) == "1"


def active_code(content: Column) -> Column:
    """The active code of a text, without comments and with blanks for literals."""
    lines = F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), "\r\n?|[\u0085\u2028\u2029]", "\n")
    pieces = F.transform(F.split(lines, r"(?m)^[^\S\n]*+#"), lambda x, i: F.struct((i > 0).alias("hash"), x.alias("text")))

    def kept(state: Column) -> Column:
        """All active code up to the state's piece."""
        return F.when(state["last"]["code"].isNull(), state["code"]).otherwise(F.array_append(state["code"], state["last"]["code"]))

    def step(state: Column, piece: Column) -> Column:
        # What grows with the text is handed on outside of what is copied.
        return F.struct(read(state["last"], piece).alias("last"), kept(state).alias("code"))

    def read(state: Column, piece: Column) -> Column:
        symbols, mode = state["symbols"], state["mode"]
        open_ = mode != ""
        word = F.when(piece["hash"] & ~open_, F.regexp_extract(piece["text"], rf"^[^\S\n]*+({_LETTER}*+)", 1)).otherwise("")
        said = F.when(piece["hash"], F.regexp_extract(piece["text"], rf"^[^\S\n]*+{_LETTER}*+((?:(?!//)[^\n])*+)", 1))
        read = F.struct(word.alias("word"), said.alias("said"), F.get(state["stack"], F.size(state["stack"]) - 1).alias("last"))
        return _let(read, lambda r: _let(F.when(r["word"].isin("if", "elif"), holds(r["said"], symbols)), lambda now: directed(state, piece, r, now)))

    def directed(state: Column, piece: Column, read: Column, held: Column) -> Column:
        """The state after the piece's directive and then its code; ``held`` is the directive's condition."""
        word, last, stack, symbols = read["word"], read["last"], state["stack"], state["symbols"]
        active, some = F.coalesce(last["now"], F.lit(True)), last.isNotNull()

        def level(now: Column, taken: Column, outside: Column) -> Column:
            return F.array(F.struct(now.alias("now"), taken.alias("taken"), outside.alias("outside")))

        below, name = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))), F.trim(read["said"])
        now = last["outside"] & ~last["taken"] & F.coalesce(held, F.lit(True))
        levels = (
            F.when(word == "if", F.concat(stack, level(active & held, active & held, active)))
            .when((word == "elif") & some, F.concat(below, level(now, last["taken"] | now, last["outside"])))
            .when((word == "else") & some, F.concat(below, level(now, F.lit(True), last["outside"])))
            .when((word == "endif") & some, below)
            .otherwise(stack)
        )
        known = F.when(active & (word == "define"), F.array_union(symbols, F.array(name))).when(active & (word == "undef"), F.array_remove(symbols, name)).otherwise(symbols)
        told = F.struct(levels.alias("stack"), known.alias("symbols"))
        return _let(told, lambda t: _let(code_of(state, piece, t), lambda bare: F.struct(
            t["stack"].alias("stack"), t["symbols"].alias("symbols"),
            F.when(bare.isNull(), state["mode"]).when(ends_open(bare), F.regexp_extract(bare, _OPEN, 1)).otherwise("").alias("mode"),
            F.when(ends_open(bare), F.regexp_replace(bare, _OPEN, "")).otherwise(bare).alias("code"),
        )))

    def ends_open(bare: Column) -> Column:
        # Quickly told, as few pieces do. (A line's end may follow what ``$`` stands for.)
        return bare.rlike(r'[*"]\n?\z')

    def code_of(state: Column, piece: Column, told: Column) -> Column:
        """The piece's code with blanks for what is none; null where it is inactive or lies within what is still open."""
        mode, text = state["mode"], piece["text"]
        whole = F.concat(F.when(piece["hash"], "#").otherwise(""), text)
        end = (
            F.when(mode == "/*", F.when(F.instr(whole, "*/") > 0, F.instr(whole, "*/") + 1).otherwise(0))
            .when(mode == '@"', F.length(F.regexp_extract(whole, r'^[^"]*+(?:""[^"]*+)*+"', 0)))
            .otherwise(F.when(F.instr(whole, mode) > 0, F.instr(whole, mode) + F.length(mode) - 1).otherwise(0))
        )
        rest = F.substring(whole, end + 1, F.length(whole))
        alive = F.coalesce(F.get(told["stack"], F.size(told["stack"]) - 1)["now"], F.lit(True))
        code = (
            F.when(mode != "", F.when(end > 1, F.when(mode.startswith('""'), F.regexp_replace(rest, '^"*+', "")).otherwise(rest)))
            .when(alive, F.when(piece["hash"], F.regexp_replace(text, r"^[^\n]*+", "")).otherwise(text))
        )
        return bare_of(code)

    def bare_of(code: Column) -> Column:
        # The pattern is so long that even to tell that it is the one of the last text takes its time.
        return F.when(code.rlike("[/\"']"), F.regexp_replace(code, _LITERAL, _KEPT)).otherwise(code)

    start = F.from_json(F.lit('{"last":{"stack":[],"symbols":[],"mode":""},"code":[]}'), _STATE)
    folded = F.aggregate(pieces, start, step, lambda s: F.array_join(kept(s), "\n"))
    # Without directives the text is one piece.
    return F.when(lines.contains("#"), folded).otherwise(F.regexp_replace(bare_of(lines), _OPEN, ""))


def declarations(code: Column) -> Column:
    """``namespaces`` (each once), ``usings`` and ``global_usings`` of active code, as a struct."""
    tokens = F.regexp_extract_all(code, F.lit(_STRUCTURE), F.lit(0))

    def read(token: Column) -> Column:
        """The kind of a token (namespace with and without braces, using, global using, brace) and the name in it; null where it tells nothing."""
        return _let(F.regexp_replace(token, rf"^{_BLANK}++", ""), lambda said: F.when(said.startswith("namespace"), declared(said)).otherwise(used(said)))

    def told(kind: Column, name: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"))

    def declared(said: Column) -> Column:
        return told(F.when(said.endswith("{"), "n").otherwise("f"), F.regexp_replace(F.substring(said, 10, 1 << 30), rf"{_BLANK}|[@{{;]", ""))

    def used(said: Column) -> Column:
        body = F.regexp_replace(said, rf"^(?:global{_BLANK}++)?+using{_BLANK}*+", "")
        name = F.regexp_replace(F.regexp_replace(body, rf"^(?:(?:static|unsafe)(?!{_LETTER}){_BLANK}*+)++", ""), rf"{_BLANK}|;", "")
        static = body.rlike(rf"^(?:unsafe{_BLANK}++)*+static(?!{_LETTER})")
        target = F.when(static, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
        return told(F.when(said.startswith("global"), "g").otherwise("u"), F.when(~said.contains("=") & said.endswith(";"), F.nullif(target, F.lit(""))))

    none = F.lit(None).cast("string")
    # All that a token says by itself is read before the fold, which so has little to do for each.
    tokens = F.transform(
        F.filter(tokens, lambda t: (F.length(t) == 1) | ~t.startswith("{")), lambda t: F.when(t.isin("{", "}"), told(t, none)).otherwise(read(t))
    )
    tokens = F.filter(tokens, lambda t: t["name"].isNotNull() | t["kind"].isin("{", "}"))

    def step(s: Column, token: Column) -> Column:
        size, top, kind, name = F.size(s["names"]), s["others"] == 0, token["kind"], token["name"]

        def state(**changed: Column) -> Column:
            kept = {c: s[c] for c in ("names", "others", "scope", "namespaces", "usings", "global_usings")}
            return F.struct(*[c.alias(n) for n, c in (kept | changed).items()])

        def full(scope: Column, names: Column) -> Column:
            return F.array_join(F.filter(F.concat(F.array(scope), names), lambda n: n != ""), ".")

        names = F.array_append(s["names"], name)
        scope = F.concat_ws(".", F.nullif(s["scope"], F.lit("")), F.nullif(name, F.lit("")))
        return (
            F.when((kind == "{") | (~top & (kind == "n")), state(names=F.array_append(s["names"], none), others=s["others"] + 1))
            .when((kind == "}") & (size > 0), state(names=F.slice(s["names"], F.lit(1), size - 1), others=s["others"] - F.get(s["names"], size - 1).isNull().cast("int")))
            .when(~top | (kind == "}"), s)
            .when(kind == "u", state(usings=F.array_append(s["usings"], name)))
            .when(kind == "g", state(global_usings=F.array_append(s["global_usings"], name)))
            .when(kind == "n", state(names=names, namespaces=F.array_append(s["namespaces"], full(s["scope"], names))))
            .otherwise(state(scope=scope, namespaces=F.array_append(s["namespaces"], full(scope, s["names"]))))
        )

    start = F.from_json(F.lit('{"names":[],"others":0,"scope":"","namespaces":[],"usings":[],"global_usings":[]}'), _FOUND)

    def finish(s: Column) -> Column:
        found = F.filter(F.array_distinct(s["namespaces"]), lambda n: n != "")
        return F.struct(found.alias("namespaces"), s["usings"].alias("usings"), s["global_usings"].alias("global_usings"))

    return F.aggregate(tokens, start, step, finish)


def parse_sources(files: DataFrame) -> DataFrame:
    """``files`` (..., content) with ``namespaces``, ``usings`` and ``global_usings``; rows without content are dropped."""
    got = files.where("content IS NOT NULL").withColumn("p", declarations(active_code(F.col("content"))))
    return got.select(*[c for c in files.columns if c != "content"], "p.namespaces", "p.usings", "p.global_usings")
