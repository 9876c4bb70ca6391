"""Expressions of any length, behind tags of any separators."""

import random
import time

import pytest

from tidemark.llm.license_scan import _automaton, parse_expression, scan_text


def scanned(text):
    *_, labels, score, _, _ = scan_text(_automaton(), text.encode())
    return set(filter(None, labels.split(","))), score


def test_long_expressions_are_read_whole():
    names = [f"licenseref-{i}.0-only" for i in range(3000)]
    assert scanned("SPDX-License-Identifier: " + " AND ".join(names)) == (set(names), 1.0)
    assert scanned("SPDX-License-Identifier: (" + " or ".join(names) + ")\nrest") == (set(names), 1.0)
    nested = " or (".join(names) + ")" * 2999
    assert scanned("license-expression = " + nested) == (set(names), 1.0)
    e = parse_expression(nested)
    assert e.allowed({names[-1]}.__contains__) and not e.allowed({"mit"}.__contains__)


@pytest.mark.parametrize("tag", ["license_expression: ", '"license_expression": "', "'license_expression' = '", "SPDX_License_Identifier=", "**SPDX-License-Identifier:** ", "é License-Expression "])
def test_tags_with_any_separator(tag):
    assert scanned(f"words before, {tag}MIT OR Apache-2.0' and after") == ({"mit", "apache-2.0"}, 1.0)


def test_many_tags_stay_linear():
    begin = time.process_time()
    assert scanned("license-expression: " + "MIT and license-expression MIT " * 20000 + "x") == ({"mit"}, 1.0)
    assert scanned("all rights reserved (c) " * 100_000)[0] == {"reserved"}
    assert scanned("license-expression: " + "(" * 100_000 + "MIT" + ")" * 100_000) == ({"mit"}, 1.0)
    assert time.process_time() - begin < 20


@pytest.mark.parametrize("text", ["License expression: the following terms hold", "The license expression is often long", "SPDX-License-Identifier: see LICENSE", "spdx license identifier and more", "license expression (MIT"])
def test_unknown_words_are_no_licences(text):
    assert scanned(text) == (set(), 0.0)


def test_known_part_of_an_expression():
    assert scanned("SPDX-License-Identifier: MIT and more of it") == ({"mit"}, 1.0)
    assert scanned("SPDX-License-Identifier: GPL-2.0-or-later WITH nothing here") == ({"gpl-2.0-or-later"}, 1.0)
    assert scanned("SPDX-License-Identifier: (MIT OR LicenseRef-Own.") == (set(), 0.0)
    assert scanned("SPDX-License-Identifier: Apache-2.0+. MIT")[0] == {"apache-2.0+"}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: OGC-1.0 OR MIT", {"unknown", "mit"}),
        ("SPDX-License-Identifier: MIT OR AGPL-1.0-only OR Parity-7.0.0 OR ISC", {"mit", "agpl-1.0-only", "unknown", "isc"}),
        ("the license expression ruby is", set()),
        ("SPDX-License-Identifier: Zlib\nor ruby code follows", {"zlib"}),
        ("SPDX-License-Identifier: MIT OR\n  Apache-2.0\nand ISC", {"mit", "apache-2.0"}),
        ("SPDX-License-Identifier: (MIT\nOR ISC)\nOR Zlib", {"mit", "isc"}),
        ("License expression:\nMIT", {"mit"}),
        ('a license expression "ISC" here', {"isc"}),
        ("SPDX license identifier MIT", {"mit"}),
        ("license expression", set()),
        ("SPDX-License-Identifier: MIT AND version-less", {"mit"}),
    ],
)
def test_unknown_names_lines_and_prose(text, labels):
    assert scanned(text) == (labels, 1.0 if labels else 0.0)
    e = parse_expression("OGC-1.0 OR MIT")
    assert e.required() == set() and e.allowed({"mit"}.__contains__) and not parse_expression("OGC-1.0 AND MIT").allowed({"mit"}.__contains__)


def brute_value(tokens, accept):
    """Precedence climbing over tokens, as a check of the shunting-yard: (satisfied, licences, required)."""

    def primary(at):
        if tokens[at] == "(":
            value, at = level(at + 1, 0)
            return value, at + 1
        name = tokens[at]
        return (name in accept, {name}, {name}), at + 1

    def level(at, least):
        left, at = primary(at)
        while at < len(tokens) and tokens[at] != ")" and {"or": 0, "and": 1}[tokens[at]] >= least:
            op = tokens[at]
            right, at = level(at + 1, {"or": 0, "and": 1}[op] + 1)
            both = left[1] | right[1]
            left = (left[0] or right[0], both, left[2] & right[2]) if op == "or" else (left[0] and right[0], both, left[2] | right[2])
        return left, at

    return level(0, 0)[0]


def test_evaluation_by_brute_force():
    rng = random.Random(3)
    names = ["mit", "isc", "gpl-2.0-only", "apache-2.0", "zlib", "licenseref-x"]

    def draw(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)]
        inner = draw(depth - 1)
        for _ in range(rng.randrange(3)):
            inner += [rng.choice(["and", "or"]), *draw(depth - 1)]
        return ["(", *inner, ")"] if rng.random() < 0.6 else inner

    for _ in range(500):
        tokens = draw(4)
        accept = set(rng.sample(names, 3))
        satisfied, licences, required = brute_value(tokens, accept)
        e = parse_expression(" ".join(tokens).upper() + " then text")
        assert (e.allowed(accept.__contains__), e.licences(), e.required()) == (satisfied, licences, required)
