"""What the scanner recognises in each language: comments, strings, definition heads, imports, bases, calls and type uses.

Patterns run over text in which comments and string contents are blanked, one character a byte; a head's
``name`` group is the symbol's name. To add a language, add an entry.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
MODS = r"(?P<mods>(?:(?:public|private|protected|static|async|abstract|final|readonly|override|internal|open|virtual|inline|export|default|pub(?:\([a-z]+\))?|unsafe|const|synchronized|native|suspend|data|sealed|get|set|\*)\s+)*)"


#: Type parameters; bounds may hold arrows, braces and parameters of their own.
TYPES = r"(?:<(?:=>|[^<>]|<(?:=>|[^<>])*>)*>)"


#: Annotations and modifiers; both are part of what they stand before.
ANNOTATED = r"(?P<mods>(?:@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*|(?:public|private|protected|static|abstract|final|default|synchronized|native|strictfp|sealed|non-sealed|transient|volatile)\s+)*)"


def rx(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("ID", ID).replace("MODS", MODS).replace("TYPES", TYPES).replace("ANNOTATED", ANNOTATED), re.MULTILINE)


@dataclass(frozen=True)
class Language:
    heads: tuple[tuple[str, re.Pattern], ...]
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    literals: tuple[tuple[str, re.Pattern], ...] = ()  # other literals: how they open, and the whole of one
    templates: bool = False  # `...${code}...`
    outside: tuple[str, str] | None = None  # tags that code stands between
    opaque: re.Pattern | None = None  # what stands before brackets whose contents are tokens, not code
    block: str = "braces"  # or "end", "indent", "statement"
    imports: tuple[re.Pattern, ...] = ()
    bases: tuple[re.Pattern, ...] = ()
    calls: tuple[re.Pattern, ...] = ()
    uses: tuple[re.Pattern, ...] = ()
    in_types: frozenset[str] = field(default_factory=frozenset)  # kinds that only count inside a type's body


#: Words that look like a call, a name or a type before ``(`` or ``$`` but are none.
NOT_CALLED = frozenset(
    "if for while switch catch return function fn func def class struct sizeof typeof new await yield super import require elseif foreach echo isset "
    "unset and or not in is do else try with when throw void defer as case public private protected static final abstract readonly var const use extends implements instanceof keyof infer satisfies".split()
)

#: A slash that begins a regular expression stands after an operator, a bracket or a keyword.
_JS_REGEX = (r"/", re.compile(r"(?<![\w$)\]}\s])\s*/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?<=[=(,:;!&|?{}\[\n+*%<>~^-] )/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*|(?:(?<=return )|(?<=typeof )|(?<=case ))/(?![*/ ])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"))
_JS_CALLS = (rx(r"(?<![\w$])(?<!new\s)(?<!function\s)(?P<name>ID)\s*\("),)
#: With type arguments a call has no space before them, or it would be a comparison.
_TS_CALLS = (*_JS_CALLS, rx(r"(?<![\w$])(?<!new\s)(?<!function\s)(?P<name>ID)<[\w$.,|\s\[\]'\"]+(?:<[\w$.,|\s\[\]]+>[\w$.,|\s\[\]]*)*>\("))
_JS_IMPORTS = (rx(r"^[ \t]*import\b[^;'\"`]*?[\"'](?P<name>[^\"']+)[\"']"),)
_JS_HEADS = (
    ("function", rx(r"(?<![\w$.])(?P<mods>(?:async\s+)?)function\s*\*?\s*(?P<name>ID)\s*TYPES?\(")),
    ("method", rx(r"(?:(?<=[{};])|^)\s*MODS(?P<name>#?ID)\s*(?:<[^>(){}]*>)?\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)\s*(?::[^{};=]+)?(?=\{)")),
    ("class", rx(r"(?<![\w$.])(?P<mods>(?:abstract\s+)?)class\s+(?P<name>ID)(?=[^;{]*\{)")),
)
_TS_HEADS = (*_JS_HEADS, ("interface", rx(r"(?<![\w$.])(?P<mods>)interface\s+(?P<name>ID)(?=[^;{]*\{)")))
_TS = Language(
    _TS_HEADS, quotes="\"'`", literals=(_JS_REGEX,), templates=True, imports=_JS_IMPORTS, calls=_TS_CALLS, in_types=frozenset({"method"}),
    bases=(rx(r"\bclass\s+(?P<sub>ID)\s*TYPES?\s+extends\s+(?P<name>ID)"),),
    uses=(rx(r"(?<=[\w$)\]?])\s*:\s*(?P<name>(?!(?:string|number|boolean|any|void|never|unknown|object|symbol|null|undefined)\b)ID)(?![\w$]|\s*[.<\[(])"),),
)

_C_PARAMETERS = r"\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|final|&|\s)*(?:->\s*[\w:<>,*& ]+)?"
_C_SCOPE = r"(?:[A-Za-z_]\w*(?:<[^<>;{}]*>)?::)"
#: Where a declaration may begin: on a line of its own, or after another one, a brace or an access label.
_C_BEGIN = r"(?:^|(?<=[{};])|(?<=public:)|(?<=private:)|(?<=protected:))[ \t]*"
_C_FUNCTION = rx(_C_BEGIN + r"MODS(?:[A-Za-z_][\w:<>,*&\[\] \t]*?[\s*&])" + _C_SCOPE + r"*(?P<name>~?[A-Za-z_]\w*)" + _C_PARAMETERS + r"(?=\{)")
_CPP_MEMBER = rx(r"^[ \t]*(?P<mods>)" + _C_SCOPE + r"+(?P<name>~?[A-Za-z_]\w*)" + _C_PARAMETERS + r"(?::[^;{}]*(?:\{[^{};]*\}[^;{}]*)*)?(?=\{)")
_C_TYPES = tuple((k, rx(rf"(?<![\w])(?P<mods>){k}\s+(?:class\s+)?(?P<name>[A-Za-z_]\w*)\b(?!\s*[,>=])(?=[^;{{()=]*\{{)")) for k in ("struct", "enum"))

LANGUAGES: dict[str, Language] = {
    "javascript": Language(
        _JS_HEADS, quotes="\"'`", literals=(_JS_REGEX,), templates=True, imports=_JS_IMPORTS, calls=_JS_CALLS, in_types=frozenset({"method"}), bases=(rx(r"\bclass\s+(?P<sub>ID)\s+extends\s+(?P<name>ID)(?!\s*[.(])"),)
    ),
    "typescript": _TS,
    "tsx": _TS,
    "go": Language(
        (
            ("function", rx(r"^(?P<mods>)func\s+(?P<name>ID)\s*(?:\[[^\]]*\])?\(")),
            ("method", rx(r"^(?P<mods>)func\s*\([^)]*\)\s*(?P<name>ID)\s*\(")),
            ("type", rx(r"^(?P<mods>)type\s+(?P<name>ID)(?=\s+[^\s=(])")),
            ("type", rx(r"(?:(?<=\()|^)[ \t]*\n?[ \t]+(?P<mods>)(?P<name>ID)\s+(?=(?:struct|interface)\s*\{)")),
        ),
        quotes="\"'`",
        imports=(rx(r"^import\s+(?:[\w.]+\s+)?\"(?P<name>[^\"]+)\""), rx(r"^[ \t]+(?:(?!return\b)[\w.]+[ \t]+)?\"(?P<name>[^\"\n]+)\"[ \t]*$")),
        calls=(rx(r"(?<![\w])(?<!func\s)(?P<name>ID)\s*\("),),
    ),
    "rust": Language(
        (
            ("function", rx(r"(?<!\w)MODSfn\s+(?P<name>ID)")),
            ("struct", rx(r"(?<!\w)MODSstruct\s+(?P<name>ID)")),
            ("enum", rx(r"(?<!\w)MODSenum\s+(?P<name>ID)")),
            ("trait", rx(r"(?<!\w)MODStrait\s+(?P<name>ID)")),
        ),
        quotes='"',
        opaque=rx(r"(?<!\w)ID!\s*(?:ID)?\s*(?=[({\[])"),
        literals=((r"r#*\"", re.compile(r'r(#*)".*?"\1', re.DOTALL)), (r"'", re.compile(r"'(?:\\.|[^'\\\n])'"))),
        imports=(rx(r"^[ \t]*(?:pub\s+)?use\s+(?P<name>[^;]+);"),),
        calls=(rx(r"(?<![\w.:])(?<!fn\s)(?P<name>ID)\s*\("),),
    ),
    "java": Language(
        (
            ("class", rx(r"(?<![\w.@])ANNOTATEDclass\s+(?P<name>ID)")),
            ("interface", rx(r"(?<![\w.@])ANNOTATEDinterface\s+(?P<name>ID)")),
            ("method", rx(r"(?:(?<=[{};])|^)\s*ANNOTATED(?:<[^>]*>\s*)?(?!(?:new|return|else|throw)\b)[A-Za-z_][\w.<>,?\[\] ]*[\s\]>](?P<name>ID)\s*\([^(){};]*\)\s*(?:throws\s+[\w., ]+)?(?=[{;])")),
        ),
        imports=(rx(r"^[ \t]*import\s+(?:static\s+)?(?P<name>[\w]+(?:\.\w+)+)\s*(?:\.\*)?;"),),
        bases=(rx(r"\bclass\s+(?P<sub>ID)\s*(?:<[^>{]*>)?\s+extends\s+(?P<name>ID)(?!\s*[.<])"),),
        calls=(rx(r"(?<![\w$@])(?<!@\w\.)(?<!new\s)(?P<name>ID)\s*\("),),
        in_types=frozenset({"method"}),
    ),
    "php": Language(
        (
            *((k, rx(rf"(?<![\w$\\:>])MODS{k}\s+(?P<name>ID)(?=[^;{{()]*\{{)")) for k in ("class", "interface", "trait", "enum")),
            ("function", rx(r"(?<![\w$])MODSfunction\s+&?\s*(?P<name>ID)\s*\(")),
        ),
        line_comments=("//", "#"),
        literals=((r"<<<", re.compile(r"<<<[ \t]*(['\"]?)(\w+)\1\r?\n.*?^[ \t]*\2\b", re.DOTALL | re.MULTILINE)),),
        outside=("<?", "?>"),
        imports=(rx(r"^[ \t]*use\s+(?:function\s+|const\s+)?\\?(?P<name>\w+(?:\\\w+)+)"),),
        bases=(
            rx(r"\bclass\s+(?P<sub>ID)\s+extends\s+(?P<name>ID)"),
            rx(r"\bclass\s+(?P<sub>ID)[^{;]*?\bimplements\s+(?P<names>[\w\\, \t\n]+)"),
        ),
        calls=(rx(r"(?<![\w$\\])(?<!new\s)(?<!function\s)(?P<name>ID)\s*\("),),
        uses=(
            rx(r"(?<=[(,\s?|])(?P<name>\\?[A-Za-z_]\w*(?:\\\w+)*)\s+(?:&|\.\.\.)?\$\w"),
            rx(r"\)\s*:\s*\??(?P<name>\\?[A-Za-z_]\w*(?:\\\w+)*)"),
            rx(r"\bnew\s+(?P<name>\\?[A-Za-z_]\w*(?:\\\w+)*)"),
            rx(r"(?<![\w$\\])(?P<name>\\?[A-Za-z_]\w*(?:\\\w+)*)::"),
        ),
    ),
    "c": Language((("function", _C_FUNCTION), *_C_TYPES)),
    "cpp": Language(
        (
            ("function", _C_FUNCTION), ("function", _CPP_MEMBER), *_C_TYPES,
            ("class", rx(r"(?<![\w])(?<!enum\s)(?P<mods>)class\s+(?P<name>[A-Za-z_]\w*)\b(?!\s*[,>=])(?=[^;{()=]*\{)")),
        ),
        literals=((r'R"', re.compile(r'R"([^()\\ ]*)\(.*?\)\1"', re.DOTALL)), (r"'", re.compile(r"(?<=\d)'(?=\d)"))),
    ),
    "c_sharp": Language(
        (
            *((k, rx(rf"(?<![\w.])MODS{k}\s+(?P<name>ID)(?=[^;{{()]*\{{)")) for k in ("class", "interface", "struct", "enum")),
            ("method", rx(r"(?:(?<=[{};])|^)\s*MODS(?!(?:new|return|else|throw|using)\b)[A-Za-z_][\w.<>,?\[\] ]*\s(?P<name>ID)\s*(?:<[^>]*>)?\([^(){};]*\)\s*(?=\{|=>)")),
        )
    ),
    "swift": Language((("function", rx(r"(?<!\w)MODSfunc\s+(?P<name>ID)")), *((k, rx(rf"(?<![\w.])MODS{k}\s+(?P<name>ID)(?=[^;{{()]*\{{)")) for k in ("class", "struct", "enum")))),
    "kotlin": Language((("function", rx(r"(?<!\w)MODSfun\s+(?:<[^>]*>\s*)?(?:ID\.)?(?P<name>ID)\s*\(")), *((k, rx(rf"(?<![\w.:])MODS{k}\s+(?P<name>ID)")) for k in ("class", "interface")))),
    "scala": Language((("function", rx(r"(?<!\w)MODSdef\s+(?P<name>ID)")), *((k, rx(rf"(?<![\w.])MODS(?:case\s+)?{k}\s+(?P<name>ID)")) for k in ("class", "trait")))),
    "ruby": Language(
        (("class", rx(r"^[ \t]*(?P<mods>)class\s+(?P<name>[A-Z]\w*)")), ("module", rx(r"^[ \t]*(?P<mods>)module\s+(?P<name>[A-Z]\w*)")), ("method", rx(r"^[ \t]*(?P<mods>)def\s+(?:self\.)?(?P<name>\w+[?!=]?)"))),
        line_comments=("#",), block_comments=(), block="end",
    ),
    "lua": Language((("function", rx(r"^[ \t]*(?P<mods>(?:local\s+)?)function\s+(?:\w+[.:])*(?P<name>\w+)\s*\(")),), line_comments=("--",), block_comments=(("--[[", "]]"),), block="end"),
    "bash": Language((("function", rx(r"^[ \t]*(?P<mods>)(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\s*\)\s*(?=\{)")), ("function", rx(r"^[ \t]*(?P<mods>)function\s+(?P<name>[A-Za-z_][\w-]*)\s*(?=\{)"))), line_comments=("#",), block_comments=()),
    "sql": Language(
        (("function", re.compile(r"(?P<mods>)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?:\w+\.)?(?P<name>\w+)", re.IGNORECASE)),), line_comments=("--",), block="statement",
    ),
    "python": Language(
        (("function", rx(r"^[ \t]*(?P<mods>(?:async\s+)?)def\s+(?P<name>\w+)\s*\(")), ("class", rx(r"^[ \t]*(?P<mods>)class\s+(?P<name>\w+)\s*[(:]"))),
        line_comments=("#",), block_comments=(), block="indent",
        imports=(rx(r"^[ \t]*import\s+(?P<name>[\w.]+)"), rx(r"^[ \t]*from\s+\.*(?P<name>[\w.]*\w)\s+import\b")),
        calls=(rx(r"(?<!\w)(?<!def\s)(?<!class\s)(?P<name>ID)\s*\("),),
    ),
}
