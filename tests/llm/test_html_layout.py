"""The one-pass renderer against a slow one, which lays out random trees box by box from the leaves up."""

import random
import re

import pytest

from orrery.llm.html_text import render

WORDS = ["ab", "c", "word", "émile", "x1", "long-winded"]


def text(rng):
    return "".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randrange(1, 5)))


def inline(rng, depth=0):
    """A list of (kind, ...): words, elements within lines, breaks between words."""
    made = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.6 or depth > 2:
            made.append(("text", text(rng)))
        elif kind < 0.8:
            made.append(("b", inline(rng, depth + 1)))
        elif kind < 0.9:
            made.append(("hidden", rng.choice(["span hidden", "b style='display:none'", "i class=gone"]), inline(rng, depth + 1)))
        else:
            made += [("text", "w"), *[("br",)] * rng.randrange(1, 4), ("text", "w")]
    return made


def blocks(rng, depth=0):
    made = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["inline", "p", "h2", "div", "pre", "hr", "gone"] + ["ul", "ol", "blockquote", "table", "div"] * (depth < 4))
        if kind in ("inline", "p", "h2"):
            made.append((kind, inline(rng)))
        elif kind in ("div", "blockquote"):
            made.append((kind, blocks(rng, depth + 1)))
        elif kind in ("ul", "ol"):
            made.append((kind, rng.randrange(0, 12), [rng.choice([inline(rng), blocks(rng, depth + 1), []]) for _ in range(rng.randrange(4))]))
        elif kind == "pre":
            lines = [rng.choice(["", "  in", "a  b"]) for _ in range(rng.randrange(4))]
            made.append((kind, ["first", *lines, "last"]))
        elif kind == "hr":
            made.append((kind,))
        elif kind == "gone":
            made.append(("hidden", rng.choice(["div hidden", "section class=gone", "div id=away", "ul style='display: none'"]), blocks(rng, 9)))
        else:
            made.append((kind, [[rng.choice([inline(rng), blocks(rng, depth + 2), []]) for _ in range(rng.randrange(4))] for _ in range(rng.randrange(4))]))
    return made


def html(nodes):
    out = []
    for kind, *rest in nodes:
        if kind == "text":
            out.append(rest[0])
        elif kind == "inline":
            out.append(html(rest[0]))
        elif kind in ("br", "hr"):
            out.append(f"<{kind}>")
        elif kind == "hidden":
            out.append(f"<{rest[0]}>{html(rest[1])}</{rest[0].split()[0]}>")
        elif kind in ("ul", "ol"):
            out.append(f"<{kind} start={rest[0]}>" + "".join(f"<li>{html(item)}</li>" for item in rest[1]) + f"</{kind}>")
        elif kind == "pre":
            out.append("<pre>\n" + "\n".join(rest[0]) + "</pre>")
        elif kind == "table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{html(cell)}</td>" for cell in row) + "</tr>" for row in rest[0]) + "</table>")
        else:
            out.append(f"<{kind}>{html(rest[0])}</{kind}>")
    return "".join(out)


def tokens(nodes, in_item=False):
    """What a box holds: text, ends of lines, gaps, and boxes that are laid out already."""
    out = []
    for kind, *rest in nodes:
        if kind == "text":
            out.append(("text", rest[0]))
        elif kind in ("b", "inline"):
            out += tokens(rest[0], in_item)
        elif kind == "br":
            out.append(("br",))
        elif kind == "hr":
            out.append(("gap",))
        elif kind == "div":
            out += [("end",), *tokens(rest[0], in_item), ("end",)]
        elif kind in ("p", "h2"):
            out += [("gap",), *tokens(rest[0], in_item), ("gap",)]
        elif kind == "pre":
            out += [("gap",), ("box", rest[0]), ("gap",)]
        elif kind == "blockquote":
            out += [("gap",), *boxed(rest[0], None, "    ", in_item), ("gap",)]
        elif kind in ("ul", "ol"):
            around = ("end",) if in_item else ("gap",)
            out.append(around)
            for n, item in enumerate(rest[1], rest[0]):
                marker = f"{n}. " if kind == "ol" else "- "
                out += boxed(item, marker, " " * len(marker), True)
            out.append(around)
        elif kind == "table":
            out += [("gap",), ("box", aligned([[lay(tokens(cell))[1] for cell in row] for row in rest[0]])), ("gap",)]
    return out


def boxed(nodes, marker, indent, in_item):
    lead, lines, trail = lay(tokens(nodes, in_item), strip=False)
    marked = []
    for line in lines:
        marked.append((indent if marker is None else marker) + line if line else "")
        if line:
            marker = None
    return [("end",), *[("gap",)] * lead, ("box", marked), *[("gap",)] * trail, ("end",)]


def lay(parts, strip=True):
    """(whether a gap comes first, lines, whether a gap comes last)."""
    lines, run, lead, gap = [], "", False, False

    def put(line):
        nonlocal lead, gap
        if gap and lines:
            lines.append("")
        lead, gap = lead or gap and not lines, False
        lines.append(line)

    def end(force=False):
        nonlocal run
        line, run = re.sub(r"[ \t\n\f\r]+", " ", run).strip(" "), ""
        if line or force:
            put(line)

    for kind, *rest in parts:
        if kind == "text":
            run += rest[0]
            continue
        end(force=kind == "br" and not gap)
        if kind == "gap":
            gap = True
        elif kind == "box":
            for line in rest[0]:
                put(line.rstrip())
    end()
    while strip and lines and not lines[-1]:
        lines.pop()
    return lead, lines, gap


def aligned(rows):
    widths = {}
    for row in rows:
        for c, lines in enumerate(row):
            widths[c] = max([widths.get(c, 0), *map(len, lines)])
    starts = {c: sum(widths[k] + 2 for k in range(c) if widths[k]) for c in widths}
    out = []
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            line = ""
            for c, lines in enumerate(row):
                if k < len(lines) and lines[k]:
                    line = line.ljust(starts[c]) + lines[k]
            out.append(line.rstrip())
    return out


@pytest.mark.parametrize("seed", range(40))
def test_random_trees(seed):
    rng = random.Random(seed)
    for _ in range(25):
        tree = blocks(rng)
        page = "<style>.gone, #away { display: none }</style>" + html(tree)
        assert render(page) == "\n".join(lay(tokens(tree))[1]), page
