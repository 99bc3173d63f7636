"""Per-page HTML tree construction (the only Python step of the engine).

Tokenising is the standard library's ``html.parser``; this module adds the
tree-construction rules of the HTML standard that change the shape of real
pages: implied html/head/body, void elements, raw text elements, implied end
tags (p, li, dd/dt, option, table parts), end tags without a match, and the
re-opening of unclosed formatting elements (``<p><b>x<p>y`` puts ``y`` in a
new ``b`` too). It returns flat rows in document order with interval
encoding: a node ``b`` lies inside ``a`` iff ``a.pre < b.pre <= a.pre_end``.

Known simplifications: no foster parenting for stray content in tables, and
the adoption agency step for mis-nested formatting end tags closes up to the
formatting element instead of cloning the block that follows it.
"""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

# Fixed values from the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE_RAW_TEXT = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_CONTENT = frozenset("base basefont bgsound link meta title style script noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header "
    "hgroup main menu nav ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form plaintext table hr xmp".split()
)
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup "
    "dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes "
    "noscript object ol p param plaintext pre script search section select source style summary table tbody td "
    "template textarea tfoot th thead title tr track ul wbr xmp".split()
)
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE_BOUNDARY = frozenset("applet caption html table td th marquee object template".split())
MARKER_ELEMENTS = frozenset("applet object marquee td th caption template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_END = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer "
    "header hgroup listing main menu nav ol pre search section summary ul form".split()
)


class _Builder(HTMLParser):
    def __init__(self, fragment: bool):
        super().__init__(convert_charrefs=True)
        self.fragment = fragment
        # parallel arrays, index = pre
        self.kind: list[str] = []
        self.tag: list[str | None] = []
        self.attrs: list[list | None] = []
        self.text: list[str | None] = []
        self.parent: list[int] = []
        self.stack: list[int] = []  # open elements (pre)
        self.active: list[int | None] = []  # active formatting elements; None = marker
        self.last_child: dict[int, int] = {}
        self.html_el = self.head_el = self.body_el = None
        self.head_closed = False

    # ---- node creation --------------------------------------------------
    def _current(self) -> int:
        return self.stack[-1] if self.stack else -1

    def _append(self, kind, tag=None, attrs=None, text=None, parent=None) -> int:
        p = self._current() if parent is None else parent
        i = len(self.kind)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.parent.append(p)
        self.last_child[p] = i
        return i

    def _element(self, tag, attrs, push=True) -> int:
        i = self._append("element", tag, attrs)
        if push and tag not in VOID:
            self.stack.append(i)
        return i

    def _text(self, data: str):
        p = self._current()
        j = self.last_child.get(p)
        if j is not None and self.kind[j] == "text" and j == len(self.kind) - 1:
            self.text[j] += data
        else:
            self._append("text", text=data)

    # ---- document scaffolding -------------------------------------------
    def _ensure_html(self, attrs=None):
        if self.html_el is None:
            self.html_el = self._element("html", list(attrs or []))
        elif attrs:
            have = {k for k, _ in self.attrs[self.html_el]}
            self.attrs[self.html_el].extend((k, v) for k, v in attrs if k not in have)

    def _ensure_head(self):
        self._ensure_html()
        if self.head_el is None:
            self.head_el = self._element("head", [])

    def _close_head(self):
        if self.head_el is not None and self.head_el in self.stack:
            del self.stack[self.stack.index(self.head_el):]
        self.head_closed = True

    def _ensure_body(self, attrs=None):
        if self.fragment or self.body_el is not None:
            return
        self._ensure_head()
        self._close_head()
        self.body_el = self._element("body", attrs or [])

    # ---- scopes ---------------------------------------------------------
    def _in_scope(self, tags, extra=frozenset()) -> bool:
        for i in reversed(self.stack):
            t = self.tag[i]
            if t in tags:
                return True
            if t in SCOPE_BOUNDARY or t in extra:
                return False
        return False

    def _pop_until(self, tags):
        while self.stack:
            i = self.stack.pop()
            if self.tag[i] in tags:
                return

    def _implied_end(self, exclude=None):
        while self.stack and self.tag[self.stack[-1]] in IMPLIED_END and self.tag[self.stack[-1]] != exclude:
            self.stack.pop()

    def _close_p(self):
        if self._in_scope({"p"}, {"button"}):
            self._implied_end("p")
            self._pop_until({"p"})

    # ---- active formatting elements ------------------------------------
    def _reconstruct(self):
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        k = len(self.active) - 1
        while k > 0 and self.active[k - 1] is not None and self.active[k - 1] not in self.stack:
            k -= 1
        for idx in range(k, len(self.active)):
            old = self.active[idx]
            self.active[idx] = self._element(self.tag[old], list(self.attrs[old]))

    def _push_active(self, i):
        same = [j for j in range(len(self.active)) if self.active[j] is not None
                and self._after_marker(j) and self.tag[self.active[j]] == self.tag[i] and self.attrs[self.active[j]] == self.attrs[i]]
        if len(same) >= 3:
            del self.active[same[0]]
        self.active.append(i)

    def _after_marker(self, j) -> bool:
        return all(x is not None for x in self.active[j + 1:])

    def _clear_to_marker(self):
        while self.active:
            if self.active.pop() is None:
                return

    def _close_formatting(self, tag) -> bool:
        """Simplified adoption agency; returns False when the tag is not active."""
        found = None
        for j in range(len(self.active) - 1, -1, -1):
            e = self.active[j]
            if e is None:
                break
            if self.tag[e] == tag:
                found = j
                break
        if found is None:
            return False
        el = self.active[found]
        if el not in self.stack:
            del self.active[found]
            return True
        if not self._in_scope({tag}):
            return True
        while self.stack:
            i = self.stack.pop()
            if i == el:
                break
        del self.active[found]
        return True

    # ---- tokens ---------------------------------------------------------
    def handle_decl(self, decl):
        if not self.fragment and decl.lower().startswith("doctype") and not self.kind:
            self._append("doctype", text=decl, parent=-1)

    def handle_comment(self, data):
        self._append("comment", text=data)

    def handle_pi(self, data):
        self._append("comment", text="?" + data)

    def unknown_decl(self, data):
        self._append("comment", text=data)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        if not data:
            return
        if self.cdata_elem is not None:
            if self.cdata_elem in ESCAPABLE_RAW_TEXT:
                data = _html.unescape(data)
            self._text(data)
            return
        if not self.fragment and self.body_el is None:
            if not data.strip(" \t\n\r\f"):
                if self.head_el is not None and not self.head_closed:
                    self._text(data)
                return
            self._ensure_body()
        self._reconstruct()
        self._text(data)

    def handle_starttag(self, tag, attrs):
        seen, clean = set(), []
        for name, value in attrs:
            if name not in seen:
                seen.add(name)
                clean.append((name, "" if value is None else value))
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
            self.set_cdata_mode(tag)
        if tag in ("html", "head", "body"):
            if self.fragment:
                return
            if tag == "html":
                self._ensure_html(clean)
            elif tag == "head":
                if self.body_el is None and not self.head_closed:
                    self._ensure_head()
            elif self.body_el is None:
                self._ensure_body(clean)
            return
        if not self.fragment and self.body_el is None:
            if tag in HEAD_CONTENT and not self.head_closed:
                self._ensure_head()
                self._element(tag, clean)
                return
            self._ensure_body()
        self._in_body_start(tag, clean)

    def _in_body_start(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_p()
            if tag in HEADINGS and self.stack and self.tag[self.stack[-1]] in HEADINGS:
                self.stack.pop()
            self._element(tag, attrs)
            return
        if tag == "li" or tag in ("dd", "dt"):
            targets = {"li"} if tag == "li" else {"dd", "dt"}
            for i in reversed(self.stack):
                t = self.tag[i]
                if t in targets:
                    self._implied_end(t)
                    self._pop_until({t})
                    break
                if t in SPECIAL and t not in ("address", "div", "p"):
                    break
            self._close_p()
            self._element(tag, attrs)
            return
        if tag in ("option", "optgroup"):
            if self.stack and self.tag[self.stack[-1]] == "option":
                self.stack.pop()
            self._reconstruct()
            self._element(tag, attrs)
            return
        if tag in ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"):
            self._table_start(tag, attrs)
            return
        if tag == "a":
            if any(e is not None and self.tag[e] == "a" and self._after_marker(j) for j, e in enumerate(self.active)):
                self._close_formatting("a")
        if tag in FORMATTING:
            self._reconstruct()
            self._push_active(self._element(tag, attrs))
            return
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT or tag in ("script", "style"):
            self._element(tag, attrs)
            return
        self._reconstruct()
        i = self._element(tag, attrs)
        if tag in MARKER_ELEMENTS:
            self.active.append(None)
        return i

    def _table_start(self, tag, attrs):
        if tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            while self.stack and self.tag[self.stack[-1]] in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"):
                if self.tag[self.stack[-1]] in ("td", "th", "caption"):
                    self._clear_to_marker()
                self.stack.pop()
            self._element(tag, attrs)
            if tag == "caption":
                self.active.append(None)
            return
        if tag == "col":
            self._element(tag, attrs)
            return
        if tag == "tr":
            while self.stack and self.tag[self.stack[-1]] in ("td", "th", "tr"):
                if self.tag[self.stack[-1]] in ("td", "th"):
                    self._clear_to_marker()
                self.stack.pop()
            if self.stack and self.tag[self.stack[-1]] == "table":
                self._element("tbody", [])
            self._element(tag, attrs)
            return
        # td / th
        while self.stack and self.tag[self.stack[-1]] in ("td", "th"):
            self._clear_to_marker()
            self.stack.pop()
        if self.stack and self.tag[self.stack[-1]] == "table":
            self._element("tbody", [])
        if self.stack and self.tag[self.stack[-1]] in ("tbody", "thead", "tfoot"):
            self._element("tr", [])
        self._element(tag, attrs)
        self.active.append(None)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "head":
            if not self.fragment:
                self._close_head()
            return
        if tag in HEAD_CONTENT and self.head_el is not None and self.head_el in self.stack:
            if self.stack and self.tag[self.stack[-1]] == tag:
                self.stack.pop()
            return
        if tag == "p":
            if not self._in_scope({"p"}, {"button"}):
                self._reconstruct()
                self._element("p", [], push=False)
                return
            self._close_p()
            return
        if tag == "br":
            self._reconstruct()
            self._element("br", [])
            return
        if tag in FORMATTING and self._close_formatting(tag):
            return
        if tag in BLOCK_END:
            if self._in_scope({tag}):
                self._implied_end()
                self._pop_until({tag})
            return
        if tag in ("dd", "dt"):
            if self._in_scope({tag}):
                self._implied_end(tag)
                self._pop_until({tag})
            return
        if tag in ("li",):
            if self._in_scope({"li"}, {"ol", "ul"}):
                self._implied_end("li")
                self._pop_until({"li"})
            return
        if tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._implied_end()
                self._pop_until(HEADINGS)
            return
        if tag in ("td", "th", "caption", "applet", "object", "marquee", "template", "table"):
            if self._in_scope({tag}) or (tag == "table" and tag in [self.tag[i] for i in self.stack]):
                self._implied_end()
                self._pop_until({tag})
                if tag != "table":
                    self._clear_to_marker()
            return
        # any other end tag: walk down the stack, stop at a special element
        for k in range(len(self.stack) - 1, -1, -1):
            i = self.stack[k]
            if self.tag[i] == tag:
                self._implied_end(tag)
                del self.stack[k:]
                return
            if self.tag[i] in SPECIAL:
                return

    def result(self):
        self.close()
        n = len(self.kind)
        pre_end = list(range(n))
        for i in range(n - 1, -1, -1):
            p = self.parent[i]
            if p >= 0 and pre_end[i] > pre_end[p]:
                pre_end[p] = pre_end[i]
        depth = [0] * n
        sib = [0] * n
        counters: dict[int, int] = {}
        for i in range(n):
            p = self.parent[i]
            depth[i] = depth[p] + 1 if p >= 0 else 0
            if self.kind[i] == "element":
                counters[p] = counters.get(p, 0) + 1
                sib[i] = counters[p]
        return pre_end, depth, sib


def parse_html(html: str | None, fragment: bool = False, predecode: bool = False):
    """Parse one page; returns a list of node tuples
    ``(pre, pre_end, parent, depth, sib_no, kind, tag, attrs, text)``."""
    src = html or ""
    if predecode:
        src = _html.unescape(src)
    b = _Builder(fragment)
    b.feed(src)
    pre_end, depth, sib = b.result()
    if not fragment and b.body_el is None:
        # every document has html/head/body
        b._ensure_body()
        pre_end, depth, sib = b.result()
    out = []
    for i in range(len(b.kind)):
        attrs = b.attrs[i]
        out.append((
            i, pre_end[i], b.parent[i], depth[i], sib[i], b.kind[i], b.tag[i],
            None if attrs is None else [{"name": k, "value": v} for k, v in attrs],
            b.text[i],
        ))
    return out
