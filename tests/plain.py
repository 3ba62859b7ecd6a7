"""Plain restatements that operators are compared with."""

import re


def sections(text):
    """(start, end, level, heading, content, blocks) of Markdown, line by line; blocks: (kind, start, end, value)."""
    rows = re.split(r"\r?\n", text or "")
    begin = 0
    pair = re.compile(r"([A-Za-z_][\w.-]*)\s*:\s*(.+)$", re.A)
    if re.fullmatch(r"---\s*", rows[0]):
        ends = [k for k in range(1, len(rows)) if re.fullmatch(r"---\s*", rows[k])]
        begin = ends[0] + 1 if ends else 0
    else:
        n = 0
        while n < len(rows) and pair.match(rows[n].strip()):
            n += 1
        begin = n + (n < len(rows) and not rows[n].strip()) if n else 0
    out, blocks, now = [], [], [begin, 0, "", []]
    code = table = listing = None

    def close(end, *, lists=True):
        nonlocal table, listing
        if table:
            blocks.append(("table", table[0], end, (table[1], table[2])))
            table = None
        if lists and listing:
            blocks.append(("list", listing[0], end, (listing[1], listing[2])))
            listing = None

    def section(end):
        content = "\n".join(now[3]).strip()
        if content or now[2]:
            out.append((now[0], end, now[1], now[2], content))

    for n in range(begin, len(rows)):
        x = rows[n]
        fence = re.match(r"(`{3,}|~{3,})(\w*)", x)
        if fence and code is None:
            close(n - 1)
            code = (n, fence[2], [])
        elif fence:
            blocks.append(("code", code[0], n, (code[1], "\n".join(code[2]))))
            code = None
        elif code is not None:
            code[2].append(x)
        elif h := re.match(r"(#{1,6})\s+(.+)", x):
            close(n - 1)
            section(n - 1)
            now = [n, len(h[1]), h[2].strip(), []]
            continue
        elif t := re.fullmatch(r"\|(.+)\|", x):
            if listing:
                blocks.append(("list", listing[0], n - 1, (listing[1], listing[2])))
                listing = None
            cells = [c.strip() for c in t[1].split("|")]
            rule = all(re.fullmatch(r"[-:]+", c) for c in cells)
            if table:
                table[2] += not rule
            else:
                table = [n, [] if rule else cells, 0]
        else:
            close(n - 1, lists=False)
            item = re.match(r"\s*(?:[-*+]|(\d+)[.)])\s+(.+)", x)
            if item and listing:
                listing[1].append(item[2].strip())
            elif item:
                listing = [n, [item[2].strip()], item[1] is not None]
            elif listing and x.strip() and re.match(r"\s{2,}", x):
                listing[1][-1] += " " + x.strip()
            elif listing and x.strip():
                close(n - 1)
        now[3].append(x)
    if code is not None:
        blocks.append(("code", code[0], len(rows) - 1, (code[1], "\n".join(code[2]))))
    close(len(rows) - 1)
    section(len(rows) - 1)
    return out, blocks


def pieces(text, size):
    """A section's text in pieces: paragraphs, sentences, cuts; written as one loop over what is left."""
    if len(text) <= size:
        return [text]
    out, held = [], ""
    for p in [q.strip() for q in re.split(r"\n\s*\n", text) if q.strip()]:
        if len(held + "\n\n" + p if held else p) <= size:
            held = held + "\n\n" + p if held else p
            continue
        if held:
            out.append(held)
        held = ""
        if len(p) <= size:
            held = p
            continue
        inner, got = "", []
        for s in re.split(r"(?<=[.!?])\s+", p):
            if len(inner + " " + s if inner else s) <= size:
                inner = inner + " " + s if inner else s
                continue
            if inner:
                got.append(inner)
            inner = s
            if len(s) > size:
                got += [s[k : k + size] for k in range(0, len(s), size)]
                inner = ""
        got += [inner] if inner else []
        # the last piece goes on with the next paragraph
        out += got[:-1]
        held = got[-1]
    return out + ([held] if held else [])
