"""License scans: an Aho-Corasick automaton for tags and notices, a shunting-yard parser for expressions.

A text is lower-cased (A-Z) and reduced to its words of letters and digits; one automaton finds
every notice phrase and every identifier tag in one pass over the words, whatever the number of
patterns. Behind a tag, wherever the automaton found it, the raw text is read as a licence
expression to its end: identifiers joined by `and`, `or` and `with`, in parentheses or not, `with`
binding closest. Identifiers of the known families (`FAMILIES`), names that begin with LicenseRef- and
exceptions behind `with` count; another name with a version behind a hyphen is a licence too, `unknown`.
Anything else ends the expression at its last well-formed point, and so does the end of a line where no operator waits for
its second side and no parenthesis is open. The tag `license expression` written as two words is prose unless a colon, an
equals sign or a quote follows.

An expression is evaluated twice: `required` lists the licences that hold whichever side of an `or`
is chosen, and `accepted` says whether a set of accepted licences suffices for all expressions of
the text (null: it has none). `labels` holds every licence that is named. The score is the certainty
that the text carries a licence notice: 0.5 for a weak phrase, 0.9 for a strong one and 1 for a valid
expression, the largest counting. All steps take time in proportion to the text.

A null text has no words. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents

# The phrases that the base counts, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notice phrases that the method adds, as (phrase, label, weight).
NOTICES = [
    ("mit license", "mit", 0.9),
    ("permission is hereby granted free of charge", "mit", 0.9),
    ("apache license", "apache-2.0", 0.9),
    ("bsd license", "bsd", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("gnu general public license", "gpl", 0.9),
    ("gnu lesser general public license", "lgpl", 0.9),
    ("gnu affero general public license", "agpl", 0.9),
    ("mozilla public license", "mpl", 0.9),
    ("eclipse public license", "epl", 0.9),
    ("isc license", "isc", 0.9),
    ("boost software license", "bsl-1.0", 0.9),
    ("unlicense", "unlicense", 0.9),
    ("creative commons", "cc", 0.5),
    ("cc by sa", "cc-by-sa", 0.9),
    ("cc by nc", "cc-by-nc", 0.9),
    ("cc by nd", "cc-by-nd", 0.9),
    ("cc0", "cc0-1.0", 0.9),
    ("public domain", "public-domain", 0.5),
    ("licensed under", "notice", 0.5),
    ("released under", "notice", 0.5),
    ("all rights reserved", "reserved", 0.5),
    ("cc by", "cc-by", 0.9),
    ("general public license", "gpl", 0.9),
]
# Words that stand before an expression.
TAGS = ["spdx license identifier", "license expression"]

_WORD = bytearray(b" " * 256)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _WORD[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD[_b] = _b + 32
# Families of licence identifiers, lower case, as patterns of a whole identifier.
FAMILIES = [
    r"(?:a|l)?gpl-[0-9]\.[0-9](?:-only|-or-later|\+)?", r"gfdl-1\.[123](?:-no-invariants|-invariants)?(?:-only|-or-later)?", r"apache-[12]\.[01]", r"mit(?:-0|-advertising|-cmu|-enna|-feh|-festival|-modern-variant|-open-group|-wu)?",
    r"bsd-[1-4]-clause(?:-[a-z-]+)?", r"0bsd", r"bsd-protection", r"bsd-source-code", r"bsl-1\.0", r"busl-1\.1", r"isc", r"mpl-[12]\.[01](?:-no-copyleft-exception)?", r"epl-[12]\.0", r"cddl-1\.[01]", r"cpl-1\.0", r"eupl-1\.[012]",
    r"cc-by(?:-nc)?(?:-nd|-sa)?-[1-4]\.[05](?:-[a-z]{2,3})?", r"cc-pddc", r"cc0-1\.0", r"cdla-(?:permissive|sharing)-[12]\.0", r"artistic-[12]\.0(?:-perl|-cl8)?", r"afl-[123]\.[0-2]", r"osl-[123]\.[01]", r"apsl-[12]\.[0-2]", r"ofl-1\.[01](?:-no-rfn|-rfn)?",
    r"unlicense", r"wtfpl", r"zlib(?:-acknowledgement)?", r"libpng(?:-2\.0)?", r"x11", r"hpnd(?:-[a-z-]+)?", r"ncsa", r"postgresql", r"psf-2\.0", r"python-2\.0(?:\.1)?", r"php-3\.[01]+", r"ruby", r"vim", r"tcl", r"curl", r"openssl", r"ssleay",
    r"json", r"icu", r"unicode-(?:dfs-201[56]|3\.0|tou)", r"w3c(?:-[0-9]+)?", r"ms-(?:pl|rl)", r"odbl-1\.0", r"odc-by-1\.0", r"pddl-1\.0", r"qpl-1\.0", r"sissl", r"sleepycat", r"sspl-1\.0", r"elastic-2\.0", r"upl-1\.0", r"ecl-[12]\.0",
    r"efl-[12]\.0", r"lppl-1\.[0-3][ac]?", r"ijg", r"imlib2", r"intel", r"beerware", r"blueoak-1\.0\.0", r"fsfap", r"fsfulr?", r"ftl", r"gd", r"ipl-1\.0", r"mulanpsl-[12]\.0", r"naist-2003", r"nasa-1\.3", r"spl-1\.0", r"xnet", r"zpl-[12]\.[01]",
    r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+",
]
#: Licences that `accepted` takes for acceptable unless told otherwise, as patterns of the same kind.
PERMISSIVE = (r"apache-.*", r"mit(?:-.*)?", r"bsd-.*", r"0bsd", r"bsl-1\.0", r"isc", r"cc-by-[1-4].*", r"cc0-1\.0", r"unlicense", r"zlib.*", r"x11", r"ncsa", r"postgresql", r"python-2.*", r"psf-2\.0")
_KNOWN = re.compile("|".join(FAMILIES))
#: Names of licences that no family has: a version stands behind a hyphen.
_VERSIONED = re.compile(r"[a-z][a-z0-9]*(?:-[a-z]+[0-9]*)*-v?[0-9]+(?:\.[0-9]+)*(?:-[a-z]+)*\+?")
UNKNOWN = "unknown"
_EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|additionref-[a-z0-9.-]+|llvm-.*|.*-linking-.*")

#: The same words in decoded text.
_RAW_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")
#: What may stand between a tag and its expression.
_BEHIND_TAG = re.compile(r"[\s\"'`*\\]*[:=]*>?[\s\"'`*\\]*")
_POINTED = re.compile(r"[:=\"'`]")
_TOKEN = re.compile(r"\s*(?:(\()|(\))|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Expression:
    """A licence expression in postfix order: identifiers, and operators over the two values before them."""

    postfix: tuple[str, ...]

    def _fold(self, leaf, join):
        values: list = []
        for x in self.postfix:
            if x in _PRECEDENCE:
                right, left = values.pop(), values.pop()
                values.append(left if x == "with" else join(x, left, right))
            else:
                values.append(leaf(x))
        return values[0]

    def licences(self) -> set[str]:
        """Every licence, exceptions left out."""
        return set(self._fold(lambda x: [x], lambda _, left, right: _joined(left, right)))

    def required(self) -> set[str]:
        """The licences of every choice: `and` needs both sides, `or` what its sides have in common."""
        numbered = {x: i for i, x in enumerate(sorted(self.licences()))}
        mask = self._fold(lambda x: 1 << numbered[x] if x in numbered else 0, lambda op, left, right: left | right if op == "and" else left & right)
        return {x for x, i in numbered.items() if mask >> i & 1}

    def allowed(self, accept) -> bool:
        """Whether licences suffice of which accept(name) holds: `or` needs one side, `and` both, `with` its licence."""
        return self._fold(accept, lambda op, left, right: (left or right) if op == "or" else (left and right))


def _joined(left: list, right: list) -> list:
    """Both lists in one; the longer is extended, so that a chain of joins takes time in proportion."""
    if len(left) < len(right):
        left, right = right, left
    left.extend(right)
    return left


def _tokens(text: str, at: int):
    """Parentheses and words from a place on, lower case, and whether each stands on a later line than what is before it."""
    while m := _TOKEN.match(text, at):
        opening, closing, word = m.groups()
        yield opening or closing or word.lower(), "\n" in text[at : m.start(m.lastindex)]
        at = m.end()


def parse_expression(text: str, at: int = 0) -> Expression | None:
    """The longest well-formed expression that starts at a place of text, by the shunting-yard algorithm."""
    # first pass: where the last token stands behind which no operand is due and no parenthesis is open
    depth, operand_due, behind_with, n_good, tokens = 0, True, False, 0, []
    for token, below in _tokens(text, at):
        if below and tokens and not operand_due and not depth:
            break
        if operand_due:
            if token == "(" and not behind_with:
                depth += 1
            elif token not in _PRECEDENCE and token not in "()":
                bare = token.rstrip(".:-")
                ended = token != bare  # a full stop at a sentence's end also ends the expression
                if not (_EXCEPTION if behind_with else _KNOWN).fullmatch(bare.removesuffix("+")):
                    if behind_with or not _VERSIONED.fullmatch(bare):
                        break
                    bare = UNKNOWN
                token, operand_due, behind_with = bare, False, False
                tokens.append(token)
                n_good = len(tokens) if not depth else n_good
                if ended:
                    break
                continue
            else:
                break
        elif token == ")" and depth:
            depth -= 1
        elif token in _PRECEDENCE:
            operand_due, behind_with = True, token == "with"
        else:
            break
        tokens.append(token)
        if not operand_due and not depth:
            n_good = len(tokens)
    if not n_good:
        return None
    output, operators = [], []
    for token in tokens[:n_good]:
        if token == "(":
            operators.append(token)
        elif token == ")":
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
        elif token in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[token]:
                output.append(operators.pop())
            operators.append(token)
        else:
            output.append(token)
    return Expression(tuple(output + operators[::-1]))


def _automaton():
    import ahocorasick

    found: dict[str, dict] = {}
    for phrase, label in BASE_PHRASES.items():
        found.setdefault(phrase, {})["base"] = label
    for phrase, label, weight in NOTICES:
        found.setdefault(phrase, {})["own"] = (label, weight)
    for phrase in TAGS:
        found.setdefault(phrase, {})["tag"] = True
    automaton = ahocorasick.Automaton()
    for phrase, what in found.items():
        automaton.add_word(f" {phrase} ", (phrase, what))
    automaton.make_automaton()
    return automaton


def scan_text(automaton, data: bytes, accept=None) -> tuple:
    """The values of FIELDS for one text."""
    accept = accept or re.compile("|".join(PERMISSIVE)).fullmatch
    words = [w for w in data.translate(bytes(_WORD)).split(b" ") if w]
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base: list[int] = []
    base_labels, labels, score = set(), set(), 0.0
    tags: list[int] = []
    counted = n_spaces = 0
    for end, (phrase, what) in automaton.iter(joined):
        # matches come in order of their ends: the number of the phrase's last word
        n_spaces, counted = n_spaces + joined.count(" ", counted, end), end
        if "base" in what:
            base.append(n_spaces - 1 - phrase.count(" "))
            base_labels.add(what["base"])
        if "own" in what:
            labels.add(what["own"][0])
            score = max(score, what["own"][1])
        if "tag" in what:
            tags.append(n_spaces - 1)
    required, accepted = set(), None
    if tags:
        raw = data.decode("utf-8", "replace")
        spans = [m.span() for m in _RAW_WORD.finditer(raw)]
        for last in tags:
            begin = _BEHIND_TAG.match(raw, spans[last][1]).end()
            own = raw[spans[last - 1][0] : spans[last][1]].lower()
            if own.split() == ["license", "expression"] and not _POINTED.search(raw, spans[last][1], begin):
                continue
            expression = parse_expression(raw, begin)
            if expression is not None:
                labels |= expression.licences()
                required |= expression.required()
                accepted = accepted is not False and bool(expression.allowed(accept))
                score = 1.0
    labels |= base_labels
    joined_set = lambda x: ",".join(sorted(x))
    return len(words), len(base), min(base, default=None), max(base, default=None), joined_set(base_labels), joined_set(labels), score, joined_set(required), accepted


FIELDS = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("required", "string"), ("accepted", "boolean")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _scan(accept: tuple[str, ...]):
    def run(batches):
        automaton, accepts = _automaton(), re.compile("|".join(accept)).fullmatch
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            for low in range(0, len(texts), 512):
                rows = [scan_text(automaton, t.as_buffer().to_pybytes(), accepts) for t in texts[low : low + 512]]
                columns = [pa.array(x, _ARROW[t]) for x, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64())[low : low + 512], *columns], names=["doc_id", *[n for n, _ in FIELDS]])

    return run


def scan_licences(docs: DataFrame, accept: tuple[str, ...] = PERMISSIVE) -> DataFrame:
    """docs (doc_id, text) -> doc_id and FIELDS. accept: patterns of the licences for `accepted`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(accept), "doc_id long, " + ", ".join(f"{n} {t}" for n, t in FIELDS))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))
