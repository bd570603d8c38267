"""Text, JSON, Markdown and HTML reports.

A report's rows come from DataFrames in their final order and are streamed to the
driver, which only lays them out. ``Sheet`` is what the formats share: a title, some
figures and sections of records with details.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

# Style classes of record types.
BADGES = {
    "WEAP": "badge-weap", "ARMO": "badge-armo", "ALCH": "badge-alch", "NPC_": "badge-npc", "MISC": "badge-misc", "AMMO": "badge-ammo",
    "BOOK": "badge-book", "KEYM": "badge-keym", "NOTE": "badge-note", "FLST": "badge-flst", "GLOB": "badge-glob",
}

STYLE = """
body { font: 15px/1.5 system-ui, sans-serif; margin: 2rem 14rem 2rem 2rem; background: #14161f; color: #dfe3ea; }
h1, h2, h3, a { color: #4fd1a5; }
table { border-collapse: collapse; width: 100%; margin: 0 0 1.5rem; }
th, td { text-align: left; padding: .4rem .7rem; border-bottom: 1px solid #2b3040; vertical-align: top; }
thead th { position: sticky; top: 0; background: #1d2130; }
th[data-sortable], .section-header, .btn-toggle { cursor: pointer; }
th.sort-asc .sort-arrow::after { content: " \\25B2"; }
th.sort-desc .sort-arrow::after { content: " \\25BC"; }
.collapsed + .section-body, .section-body.collapsed { display: none; }
.toc { position: fixed; top: 1rem; right: 1rem; width: 11rem; }
.toc a { display: block; }
.toc a.active { font-weight: bold; }
.summary { display: flex; gap: 1rem; }
.stat { border-left: 4px solid #4fd1a5; padding: .3rem 1rem; }
.stat-removed { border-color: #e5616b; }
.stat-modified { border-color: #e2b04a; }
.badge { border-radius: .6rem; padding: 0 .5rem; background: #3a4157; }
.badge-weap { background: #7c3a3a; } .badge-armo { background: #3a567c; } .badge-alch { background: #3a7c4c; }
.badge-npc { background: #6a3a7c; } .badge-misc { background: #5a5a5a; } .badge-ammo { background: #7c653a; }
.hash-only { opacity: .6; }
#scroll-top { display: none; position: fixed; right: 1rem; bottom: 1rem; }
#lightbox { display: none; position: fixed; inset: 0; background: #000c; }
#lightbox.visible { display: grid; place-items: center; }
img.icon { max-height: 48px; }
"""

SCRIPT = """
const all = (q, e = document) => [...e.querySelectorAll(q)];
all('.filterable').forEach(box => {
  const rows = all(':scope > table > tbody > tr', box), input = box.querySelector('.table-filter input[type=text]'), count = box.querySelector('.count');
  const show = () => {
    const q = input.value.toLowerCase(), hide = box.querySelector('#hide-hash-only')?.checked;
    let n = 0;
    for (const r of rows) {
      const on = r.textContent.toLowerCase().includes(q) && !(hide && r.dataset.hashOnly);
      r.hidden = !on;
      n += on;
    }
    count.textContent = n === rows.length ? `${n} rows` : `${n} / ${rows.length}`;
  };
  all('input', box).forEach(i => i.addEventListener('input', show));
  show();
});
all('th[data-sortable]').forEach(th => th.addEventListener('click', () => {
  const body = th.closest('table').tBodies[0], at = th.cellIndex, down = th.classList.contains('sort-asc');
  all('th', th.parentElement).forEach(x => x.classList.remove('sort-asc', 'sort-desc'));
  th.classList.add(down ? 'sort-desc' : 'sort-asc');
  const key = r => r.cells[at].textContent.trim();
  const order = (a, b) => { const x = parseFloat(a), y = parseFloat(b); return isNaN(x) || isNaN(y) ? a.localeCompare(b) : x - y; };
  [...body.rows].sort((a, b) => order(key(a), key(b)) * (down ? -1 : 1)).forEach(r => body.append(r));
}));
all('.section-header').forEach(h => h.addEventListener('click', () => { h.classList.toggle('collapsed'); h.nextElementSibling.classList.toggle('collapsed'); }));
all('.btn-toggle').forEach(b => b.addEventListener('click', () => {
  const box = document.getElementById(b.dataset.target), open = box.style.display === 'none';
  box.style.display = open ? '' : 'none';
  b.textContent = b.textContent.replace(open ? 'Show' : 'Hide', open ? 'Hide' : 'Show');
}));
const top_ = document.getElementById('scroll-top'), links = all('.toc a');
addEventListener('scroll', () => {
  top_.style.display = scrollY > 400 ? 'block' : 'none';
  const seen = links.filter(a => document.querySelector(a.hash)?.getBoundingClientRect().top <= 120).pop();
  links.forEach(a => a.classList.toggle('active', a === seen));
});
top_.addEventListener('click', () => scrollTo({top: 0, behavior: 'smooth'}));
const box = document.getElementById('lightbox');
all('img.icon').forEach(i => i.addEventListener('click', () => { box.firstElementChild.src = i.dataset.full || i.src; box.classList.add('visible'); }));
box.addEventListener('click', () => box.classList.remove('visible'));
"""


@dataclass
class Link:
    """A reference between two records of a report, seen from one of them."""

    field: str
    form_id: int
    name: str

    @property
    def hex(self) -> str:
        return hex_of(self.form_id)


@dataclass
class Item:
    """A record of a report with its details, those it has."""

    form_id: int
    record_type: str
    editor_id: str | None = None
    full_name: str | None = None
    fields: list[tuple[str, str]] = field(default_factory=list)
    changes: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    refers: list[Link] = field(default_factory=list)
    referred: list[Link] = field(default_factory=list)
    icon: str | None = None

    @property
    def hex(self) -> str:
        return hex_of(self.form_id)

    @property
    def title(self) -> str:
        return self.full_name or self.editor_id or self.hex


def hex_of(form_id: int) -> str:
    return f"0x{form_id:08X}"


def escape(text: str | None) -> str:
    """&, < and > as character references; quotes stay."""
    out = text or ""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = out.replace(a, b)
    return out


# Diff reports


@dataclass
class Diff:
    old_id: int
    new_id: int
    old_label: str
    new_label: str
    added: list[Item] = field(default_factory=list)
    removed: list[Item] = field(default_factory=list)
    modified: list[Item] = field(default_factory=list)

    @property
    def parts(self) -> tuple[tuple[str, str, list[Item]], ...]:
        return (("added", "+", self.added), ("removed", "-", self.removed), ("modified", "~", self.modified))


def _text_links(item: Item) -> Iterator[str]:
    for x in item.refers:
        yield f"      → references: {x.name} ({x.hex}) via {x.field}"
    for x in item.referred:
        yield f"      ← referenced by: {x.name} ({x.hex}) via {x.field}"


def diff_text(d: Diff) -> str:
    lines = [f"Diff: #{d.old_id} ({d.old_label}) -> #{d.new_id} ({d.new_label})"]
    lines += [f"Added: {len(d.added)}  Removed: {len(d.removed)}  Modified: {len(d.modified)}", ""]
    for kind, sign, items in d.parts:
        if not items:
            continue
        lines.append(f"=== {kind.upper()} ({len(items)}) ===")
        for x in items:
            if kind == "modified":
                lines.append(f"  ~ {x.hex}  {x.record_type:<6}  {x.full_name or x.editor_id or ''}")
                lines += [f"      {n}: {old or '(none)'} -> {new or '(none)'}" for n, old, new in x.changes]
            else:
                lines.append(f"  {sign} {x.hex}  {x.record_type:<6}  {x.editor_id or '':<40}  {x.full_name or ''}")
                lines += [f"      {n}: {v}" for n, v in x.fields]
            lines += _text_links(x)
        if kind != "modified":
            lines.append("")
    return "\n".join(lines)


def diff_json(d: Diff) -> str:
    def entry(x: Item, modified: bool) -> dict:
        out: dict = {"form_id": x.hex, "type": x.record_type, "editor_id": x.editor_id, "name": x.full_name}
        if modified:
            out["changes"] = [{"field": n, "old": old, "new": new} for n, old, new in x.changes]
        elif x.fields:
            out["fields"] = dict(x.fields)
        if x.refers:
            out["references"] = [{"field": r.field, "target": r.hex, "name": r.name} for r in x.refers]
        if x.referred:
            out["referenced_by"] = [{"source": r.hex, "name": r.name, "field": r.field} for r in x.referred]
        return out

    data: dict = {kind: [entry(x, kind == "modified") for x in items] for kind, _, items in d.parts}
    data["summary"] = {kind: len(items) for kind, _, items in d.parts}
    return json.dumps(data, indent=2)


def _row(cells: Iterable[str]) -> str:
    return f"| {' | '.join(cells)} |"


def record_table(items: Iterable[Item], icons: bool = False) -> list[str]:
    """A Markdown table of records."""
    names = (["Icon"] if icons else []) + ["FormID", "Type", "Editor ID", "Name"]
    lines = [_row(names), "|" + "|".join("-" * (len(n) + 2) for n in names) + "|"]
    for x in items:
        icon = [f"![icon]({x.icon})" if x.icon else ""] if icons else []
        lines.append(_row([*icon, x.hex, x.record_type, x.editor_id or "", x.full_name or ""]))
    return lines


def _markdown_links(item: Item) -> list[str]:
    if not item.refers and not item.referred:
        return []
    lines = ["", "**Related records in this diff:**", ""]
    lines += [f"- → `{x.field}` → {x.name} (`{x.hex}`)" for x in item.refers]
    return lines + [f"- ← referenced by {x.name} (`{x.hex}`) via `{x.field}`" for x in item.referred]


def _field_table(fields: Iterable[tuple[str, str]]) -> list[str]:
    return ["| Field | Value |", "|-------|-------|", *[_row(f) for f in fields]]


def diff_markdown(d: Diff, icons: bool = False) -> str:
    lines = [f"# Diff: {d.old_label} -> {d.new_label}", "", "| Metric | Count |", "|--------|-------|"]
    lines += [*[_row((kind.capitalize(), str(len(items)))) for kind, _, items in d.parts], ""]
    for kind, _, items in d.parts:
        if not items:
            continue
        lines.append(f"## {kind.capitalize()} ({len(items)})")
        if kind != "modified":
            lines += [*record_table(items, icons), ""]
            for x in items:
                if x.fields:
                    lines += [f"### {x.title} ({x.hex})", *_field_table(x.fields), *_markdown_links(x), ""]
            continue
        for x in items:
            lines.append(f"### {x.title} ({x.hex})" + (f" ![icon]({x.icon})" if icons and x.icon else ""))
            if x.changes:
                lines += ["| Field | Old | New |", "|-------|-----|-----|"]
                lines += [_row((n, old or "", new or "")) for n, old, new in x.changes]
            lines += [*_markdown_links(x), ""]
    return "\n".join(lines)


# HTML


def page(title: str, body: str) -> str:
    """A whole document around the body."""
    return (
        f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'>\n<meta name='viewport' content='width=device-width, initial-scale=1'>\n"
        f"<title>{escape(title)}</title>\n<style>{STYLE}</style></head>\n<body>\n{body}\n"
        f'<div id="lightbox"><img id="lb-img" alt=""></div>\n<button id="scroll-top" title="Scroll to top">&#9650;</button>\n'
        f"<script>{SCRIPT}</script>\n</body></html>"
    )


def badge(record_type: str) -> str:
    return f'<span class="badge {BADGES.get(record_type, "badge-default")}">{escape(record_type)}</span>'


def _icon(item: Item) -> str:
    if not item.icon:
        return ""
    return f'<img class="icon" src="{item.icon}" data-full="{item.icon.replace("icons/", "icons/full/", 1)}" alt="">'


def _heads(names: Iterable[str], icons: bool) -> str:
    cells = "".join(f'<th data-sortable>{n}<span class="sort-arrow"></span></th>' for n in names)
    return f"<table><thead><tr>{'<th>Icon</th>' if icons else ''}{cells}</tr></thead><tbody>"


def _plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def _details(key: str, label: str, count: str, heads: tuple[str, ...], rows: Iterable[tuple[str, ...]]) -> str:
    """A cell with a button that shows a small table."""
    head = f"<thead><tr>{''.join(f'<th>{h}</th>' for h in heads)}</tr></thead>" if heads else ""
    body = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
    return (
        f'<td><button class="btn-toggle" data-target="{key}">Show {label}</button> ({count})'
        f'<div class="inline-changes" id="{key}" style="display:none"><table>{head}<tbody>{body}</tbody></table></div></td>'
    )


def _links_cell(item: Item, key: str) -> str:
    n = len(item.refers) + len(item.referred)
    if not n:
        return "<td></td>"
    rows = [(f"&rarr; {escape(x.field)}", f"{escape(x.name)} ({x.hex})") for x in item.refers]
    rows += [(f"&larr; {escape(x.field)}", f"{escape(x.name)} ({x.hex})") for x in item.referred]
    return _details(f"xref-{key}", "related", _plural(n, "ref"), (), rows)


def _filter(more: str = "") -> str:
    return f'<div class="table-filter"><input type="text" placeholder="Filter rows..."><span class="count"></span>{more}</div>'


def html_table(items: Iterable[Item], key: str, icons: bool, notice: str = "") -> str:
    """A filterable table of records."""
    rows = [f'<div class="filterable" id="{key}">{_filter()}{notice}', _heads(("FormID", "Type", "Editor ID", "Name"), icons)]
    for x in items:
        icon = f"<td>{_icon(x)}</td>" if icons else ""
        rows.append(f"<tr>{icon}<td>{x.hex}</td><td>{badge(x.record_type)}</td><td>{escape(x.editor_id)}</td><td>{escape(x.full_name)}</td></tr>")
    return "\n".join([*rows, "</tbody></table></div>"])


def _contents(links: Iterable[tuple[str, str]]) -> str:
    return '<nav class="toc"><h3>Contents</h3>' + "\n".join(f'<a href="#{k}">{escape(t)}</a>' for k, t in links) + "</nav>"


def diff_html(d: Diff) -> str:
    icons = any(x.icon for _, _, items in d.parts for x in items)
    there = [(kind, items) for kind, _, items in d.parts if items]
    out = [_contents([("summary", "Summary"), *[(f"section-{k}", f"{k.capitalize()} ({len(i)})") for k, i in there]])]
    out.append(f'<h1 id="summary">Diff: {escape(d.old_label)} &rarr; {escape(d.new_label)}</h1><div class="summary">')
    for kind, _, items in d.parts:
        out.append(f'<div class="stat stat-{kind}"><div class="label">{kind.capitalize()}</div><div class="value {kind}">{len(items)}</div></div>')
    out.append("</div>")
    for kind, items in there:
        out.append(f'<h2 class="section-header {kind}" id="section-{kind}">{kind.capitalize()} ({len(items)})</h2><div class="section-body">')
        changed = kind == "modified"
        hide = '<label><input type="checkbox" id="hide-hash-only" checked>Hide hash-only</label>' if changed else ""
        names = ("FormID", "Type", "Name", "Changes", "Related") if changed else ("FormID", "Type", "Editor ID", "Name", "Fields", "Related")
        out.append(f'<div class="filterable" id="tbl-{kind}">{_filter(hide)}{_heads(names, icons)}')
        for i, x in enumerate(items):
            icon = f"<td>{_icon(x)}</td>" if icons else ""
            if changed:
                named = f"<td>{escape(x.title)}</td>"
                rows = [(escape(n), escape(old), escape(new)) for n, old, new in x.changes]
                cell = _details(f"detail-{i}", "changes", _plural(len(rows), "field"), ("Field", "Old", "New"), rows)
                cell = cell if rows else '<td><span class="hash-only">hash only</span></td>'
            else:
                named = f"<td>{escape(x.editor_id)}</td><td>{escape(x.full_name)}</td>"
                rows = [(escape(n), escape(v)) for n, v in x.fields]
                cell = _details(f"{kind}-detail-{i}", "fields", _plural(len(rows), "field"), ("Field", "Value"), rows) if rows else "<td></td>"
            mark = ' data-hash-only="1"' if changed and not x.changes else ""
            out.append(f"<tr{mark}>{icon}<td>{x.hex}</td><td>{badge(x.record_type)}</td>{named}{cell}{_links_cell(x, f'{kind}-{i}')}</tr>")
        out.append("</tbody></table></div></div>")
    return page(f"Diff: {d.old_label} → {d.new_label}", "\n".join(out))


# Searches, heuristics, exports

HIDDEN_FIELDS = ("icon", "icon_small")


def search_text(items: list[Item]) -> str:
    lines = [f"Found {len(items)} records:", "", f"{'FormID':<12}  {'Type':<6}  {'Editor ID':<40}  Name", "-" * 90]
    lines += [f"{x.hex:<12}  {x.record_type:<6}  {x.editor_id or '':<40}  {x.full_name or ''}" for x in items]
    for x in items:
        if x.fields:
            lines += ["", f"  {x.hex} decoded fields:", *[f"    {n}: {v}" for n, v in x.fields]]
    return "\n".join(lines)


def search_markdown(items: list[Item], icons: bool = False) -> str:
    lines = [f"# Search Results ({len(items)} records)", "", *record_table(items, icons)]
    for x in items:
        if x.fields:
            lines += ["", f"### {x.title} ({x.hex})", *_field_table(f for f in x.fields if f[0] not in HIDDEN_FIELDS)]
    return "\n".join(lines)


def search_html(items: list[Item]) -> str:
    icons = any(x.icon for x in items)
    out = [f"<h1>Search Results ({len(items)} records)</h1>", html_table(items, "tbl-search", icons)]
    for x in items:
        if x.fields:
            rows = "".join(f"<tr><td>{escape(n)}</td><td>{escape(v)}</td></tr>" for n, v in x.fields if n not in HIDDEN_FIELDS)
            out.append(f'<h3 class="section-header">{_icon(x)} {escape(x.title)} ({x.hex})</h3><div class="section-body">')
            out.append(f'<table class="change-table"><thead><tr><th>Field</th><th>Value</th></tr></thead><tbody>{rows}</tbody></table></div>')
    return page("Search Results", "\n".join(out))


@dataclass
class Category:
    """A category of unreleased records: how many there are, and those that are shown."""

    name: str
    total: int
    items: list[Item]


def unreleased_text(categories: list[Category]) -> str:
    lines = []
    for c in categories:
        lines += ["", "=" * 60, f"  {c.name} ({c.total} items)", "=" * 60]
        lines += [f"  {x.hex}  {x.record_type:<6}  {x.editor_id or '':<45}  {x.full_name or ''}" for x in c.items]
        if c.total > len(c.items):
            lines.append(f"  ... and {c.total - len(c.items)} more")
    return "\n".join(lines)


def unreleased_markdown(categories: list[Category], icons: bool = False) -> str:
    lines = ["# Unreleased Content", "", "| Category | Count |", "|----------|-------|"]
    lines += [*[_row((c.name, str(c.total))) for c in categories], ""]
    for c in categories:
        lines += [f"## {c.name} ({c.total} items)", *record_table(c.items, icons), ""]
    return "\n".join(lines)


def unreleased_html(categories: list[Category]) -> str:
    icons = any(x.icon for c in categories for x in c.items)
    key = lambda c: "cat-" + c.name.replace(" ", "-").lower()
    out = [_contents([("summary", "Summary"), *[(key(c), f"{c.name} ({c.total})") for c in categories]])]
    out.append('<h1 id="summary">Unreleased Content</h1><div class="summary">')
    for label, n in [("Total Items", sum(c.total for c in categories)), *[(c.name, c.total) for c in categories]]:
        out.append(f'<div class="stat"><div class="label">{escape(label)}</div><div class="value">{n}</div></div>')
    out.append("</div>")
    for i, c in enumerate(categories):
        out.append(f'<h2 class="section-header" id="{key(c)}">{escape(c.name)} ({c.total} items)</h2><div class="section-body">')
        out += [html_table(c.items, f"tbl-unrel-{i}", icons, _notice(len(c.items), c.total)), "</div>"]
    return page("Unreleased Content", "\n".join(out))


def _notice(shown: int, total: int) -> str:
    return f'<div class="truncation-notice">Showing {shown} of {total} records.</div>' if total > shown else ""


def export_markdown(items: Iterable[Item], total: int, record_type: str | None = None, icons: bool = False) -> str:
    lines = [f"# Export: {record_type or 'All Records'}", "", f"Total: {total} records", ""]
    return "\n".join([*lines, *record_table(items, icons)])


def export_html(items: list[Item], total: int, record_type: str | None = None) -> str:
    title = f"Export: {record_type or 'All Records'}"
    icons = any(x.icon for x in items)
    body = [f"<h1>{escape(title)}</h1>", f"<p>Total: {total} records</p>", html_table(items, "tbl-export", icons, _notice(len(items), total))]
    return page(title, "\n".join(body))
