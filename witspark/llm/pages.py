"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of elements and texts. Every node has a hidden state:
boilerplate, content, or frame (holds content and other things). Unary potentials
come from the node's tag, the words of its class and id, its link density, text
length and punctuation; parent-child potentials say how states follow down the
tree. Messages are passed upward and then downward (sum-product), and a text is
taken if its marginal probability of content is above 1/2.

Potentials are smoothed counts. They are trained from labelled pages:
those whose author marked the article with exactly one `article` or `main`
element; what lies in it is content, its ancestors are frame, the rest is
boilerplate, and so are menus, forms, notices and comments inside it. Priors
hold what tags and class words say on the web in general (`PRIOR_TAGS`,
`PRIOR_WORDS`), so that pages with other templates are read as well. Training
takes a bounded sample of `max_pages` pages, those with the smallest hash;
extraction covers all pages and the whole html.

Scripts, styles, comments and the head hold no text. Character references are
decoded, white space folds to one space, blocks follow in page order.

Defined cases: null or empty html gives an empty text; unclosed or unmatched tags
are closed as far as their ancestors need it; without labelled pages the priors
alone decide; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from witspark.llm.common import id_type, map_rows, prepare

BOILERPLATE, CONTENT, FRAME = range(3)

#: Tags and class words with what they say in general: a state, and how much less
#: likely (natural logarithm) the other states are.
PRIOR_TAGS = {
    **dict.fromkeys(
        "nav footer aside header form menu button select textarea label fieldset dialog iframe".split(),
        (BOILERPLATE, 60.0),
    ),
    **dict.fromkeys("article main".split(), (CONTENT, 12.0)),
    **dict.fromkeys("html body".split(), (FRAME, 10.0)),
    **dict.fromkeys("p h1 h2 h3 blockquote pre figcaption".split(), (CONTENT, 0.5)),
}
PRIOR_WORDS = {
    **dict.fromkeys(
        "nav navbar navigation menu header masthead footer sidebar aside ad ads advert advertisement"
        " banner promo sponsor sponsored cookie cookies consent notice popup modal overlay comment"
        " comments reply replies disqus share social related recommended breadcrumb breadcrumbs form"
        " login signup subscribe newsletter widget toolbar pagination pager copyright legal tags meta"
        " skip hidden alert toast".split(),
        (BOILERPLATE, 60.0),
    ),
    **dict.fromkeys("article story entry post content articlebody maincontent".split(), (CONTENT, 9.0)),
    **dict.fromkeys("wrapper container page site layout root app".split(), (FRAME, 2.0)),
}

WHOLE = frozenset("html body main article".split())
SILENT = frozenset("script style head title template noscript svg math object iframe audio video canvas".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span"
    " strike strong sub sup time tt u var wbr img input label".split()
)
#: A new block of these ends an open paragraph.
CLOSES_P = frozenset(
    "p div ul ol dl table section article aside header footer nav main form h1 h2 h3 h4 h5 h6 pre"
    " blockquote figure fieldset hr address details".split()
)
#: Siblings that end one another.
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div nav aside footer form main select td th".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: What a token can be where no ">" follows; it has the groups of `TOKEN`, all empty.
REST = re.compile(r"<!--.*\Z|<[!?][^>]*\Z" + "|(?!)()()()()()()", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none""", re.I)


class Tree:
    """Nodes in page order: parent, tag (None for a text), features, text, block breaks."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str | None] = ["#root"]
        self.words: list[tuple] = [()]
        self.text: list[str] = [""]
        self.flow: list[int] = []  # text nodes in order; -1 is a block break
        stack = [0]
        self.open: Counter = Counter()  # elements of the stack by tag
        self.silent = 0  # those that hold no text
        at, end = 0, len(source)
        last = source.rfind(">")
        match = (TOKEN if last >= 0 else REST).search(source)
        while True:
            stop = match.start() if match else end
            if stop > at and not self.silent:
                self._add_text(stack[-1], source[at:stop])
            if not match:
                break
            at = match.end()
            close, name, attributes = match.group(1), match.group(2), match.group(3)
            if name is None:
                close, name, attributes = match.group(4), match.group(5), match.group(6)
            if name is not None:
                name = name.lower()
                if name not in INLINE:
                    self.flow.append(-1)
                if close:
                    if self.open[name]:
                        depth = len(stack) - 1
                        while self.tag[stack[depth]] != name:
                            depth -= 1
                        self._shut(stack, depth)
                elif name not in VOID:
                    self._end_open(stack, name)
                    node = self._add(stack[-1], name, attributes)
                    stack.append(node)
                    self.open[name] += 1
                    self.silent += name in SILENT
                    if name in RAW:
                        finish = re.compile(f"</{name}", re.I).search(source, at)
                        stop = finish.start() if finish else end
                        if not self.silent and stop > at:
                            self._add_text(node, source[at:stop])
                        at = stop
            # Behind the last ">" only a comment or a declaration can still begin.
            match = (TOKEN if at <= last else REST).search(source, at)

    def _shut(self, stack, depth):
        """Close the elements from `depth` on; each is closed once."""

        for node in stack[depth:]:
            self.open[self.tag[node]] -= 1
            self.silent -= self.tag[node] in SILENT
        del stack[depth:]

    def _end_open(self, stack, name):
        if name in CLOSES_P:
            targets = ("p",)
        elif name in SIBLING:
            targets = SIBLING[name]
        else:
            return
        if not any(self.open[tag] for tag in targets):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in targets:
                self._shut(stack, depth)
                return
            if tag in SCOPE:
                return

    def _add(self, parent, tag, attributes):
        words: tuple = ()
        # Page-wide elements carry class words about their parts, which say nothing of themselves.
        if attributes and tag not in WHOLE:
            found = {
                w for m in NAMES.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())
            }
            if HIDDEN.search(attributes):
                found.add("hidden")
            words = tuple(sorted(found))
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append("")
        return len(self.tag) - 1

    def _add_text(self, parent, raw):
        text = html.unescape(raw) if "&" in raw else raw
        self.parent.append(parent)
        self.tag.append(None)
        self.words.append(())
        self.text.append(text)
        self.flow.append(len(self.tag) - 1)

    def kept(self, taken) -> str:
        parts = []
        for node in self.flow:
            if node < 0:
                parts.append(" ")
            elif taken[node]:
                parts.append(self.text[node])
        return " ".join("".join(parts).split())

    def features(self) -> list[list[str]]:
        """Feature names of each node; class words beyond the known ones share 256 names."""

        n = len(self.tag)
        size, linked = [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.tag[i] is None:
                size[i] = len(self.text[i].strip())
            elif self.tag[i] == "a":
                linked[i] = size[i]
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        out = []
        for i in range(n):
            tag = self.tag[i]
            length = min(9, size[i].bit_length())
            if tag is None:
                last = self.text[i].rstrip()[-1:]
                out.append([f"text:{length}", f"ends:{int(last in '.!?:;' and last != '')}"])
            else:
                density = int(4 * linked[i] / size[i]) if size[i] else 5
                own = [f"tag:{tag if tag in KNOWN else 'other'}", f"links:{density}", f"size:{length}"]
                for word in self.words[i]:
                    own.append(
                        f"word:{word}" if word in PRIOR_WORDS else f"word:#{zlib.crc32(word.encode()) % 256}"
                    )
                out.append(own)
        return out

    def labels(self) -> list[int] | None:
        """States of all nodes where the author marked one article; else None."""

        marked = [i for i, tag in enumerate(self.tag) if tag == "article"]
        if not marked:
            marked = [i for i, tag in enumerate(self.tag) if tag == "main"]
        if len(marked) != 1:
            return None
        article = marked[0]
        state = [BOILERPLATE] * len(self.tag)
        up = self.parent[article]
        while up >= 0:
            state[up] = FRAME
            up = self.parent[up]
        for i in range(article, len(self.tag)):
            inside = i == article or state[self.parent[i]] == CONTENT
            against = PRIOR_TAGS.get(self.tag[i], (CONTENT,))[0] == BOILERPLATE or any(
                PRIOR_WORDS.get(w, (CONTENT,))[0] == BOILERPLATE for w in self.words[i]
            )
            if inside and not against:
                state[i] = CONTENT
        return state


KNOWN = frozenset(
    "#root html body div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th"
    " blockquote pre figure figcaption address details summary center".split()
) | PRIOR_TAGS.keys() | INLINE


#: How much (natural logarithm) a trained feature of a kind may say at most: these
#: depend on each other and on the templates of the sample.
LIMIT = {"tag": 0.7, "word": 2.0, "links": 0.7, "size": 0.3, "text": 0.5, "ends": 0.3}

#: Share of the general parent-child potentials beside the trained ones.
GENERAL = 0.5


class Model:
    """Log potentials. `unary[feature]` has one value per state, `pair[parent][child]` by kind."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        """`counts` by (feature or "pair:kind", state, state of the parent or 0)."""

        totals: dict[tuple[str, int], float] = {}
        seen: dict[str, list[float]] = {}
        pairs: dict[str, list[list[float]]] = {}
        for (name, state, parent), n in counts.items():
            if name.startswith("pair:"):
                pairs.setdefault(name[5:], [[0.0] * 3 for _ in range(3)])[parent][state] += n
            else:
                seen.setdefault(name, [0.0] * 3)[state] += n
        for name, own in seen.items():
            kind = name.split(":")[0]
            for state in range(3):
                totals[kind, state] = totals.get((kind, state), 0.0) + own[state] + 1.0
        self.unary = {}
        for name, own in seen.items():
            kind = name.split(":")[0]
            logs = [math.log((own[s] + 1.0) / totals[kind, s]) for s in range(3)]
            self.unary[name] = [max(v - max(logs), -LIMIT[kind]) for v in logs]
        for prefix, table in (("tag:", PRIOR_TAGS), ("word:", PRIOR_WORDS)):
            for name, (state, strength) in table.items():
                learnt = self.unary.get(prefix + name, [0.0] * 3)
                self.unary[prefix + name] = [
                    v - (strength if s != state else 0.0) for s, v in enumerate(learnt)
                ]
        # Content and boilerplate pass on to the children; a frame leaves them open.
        general = {
            "text": [[0.98, 0.01, 0.01], [0.02, 0.97, 0.01], [0.6, 0.35, 0.05]],
            "element": [[0.98, 0.01, 0.01], [0.05, 0.94, 0.01], [0.35, 0.35, 0.3]],
        }
        self.pair = {}
        for kind, prior in general.items():
            trained = pairs.get(kind, [[0.0] * 3] * 3)
            self.pair[kind] = [
                [GENERAL * p + (1 - GENERAL) * (n + 20 * p) / (sum(row) + 20) for n, p in zip(row, expected)]
                for row, expected in zip(trained, prior)
            ]

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by one upward and one downward pass."""

        n = len(tree.tag)
        belief = []
        for names in tree.features():
            logs = [0.0, 0.0, 0.0]
            for name in names:
                own = self.unary.get(name)
                if own:
                    logs = [a + b for a, b in zip(logs, own)]
            top = max(logs)
            belief.append([math.exp(v - top) for v in logs])
        text, element = self.pair["text"], self.pair["element"]
        up: list = [None] * n
        for i in range(n - 1, 0, -1):
            b0, b1, b2 = belief[i]
            message = [r[0] * b0 + r[1] * b1 + r[2] * b2 for r in (text if tree.tag[i] is None else element)]
            scale = sum(message)
            up[i] = message = [m / scale for m in message]
            own = belief[tree.parent[i]]
            own[0] *= message[0]
            own[1] *= message[1]
            own[2] *= message[2]
            scale = own[0] + own[1] + own[2]
            if scale < 1e-100:
                own[:] = [v / (scale or 1e-300) for v in own] if scale else [1.0, 1.0, 1.0]
        out = [0.0] * n
        scale = sum(belief[0])
        belief[0] = [v / scale for v in belief[0]]
        for i in range(1, n):
            above, sent = belief[tree.parent[i]], up[i]
            rest = [a / max(s, 1e-300) for a, s in zip(above, sent)]
            rows = text if tree.tag[i] is None else element
            own = [
                belief[i][s] * (rest[0] * rows[0][s] + rest[1] * rows[1][s] + rest[2] * rows[2][s]) for s in range(3)
            ]
            scale = sum(own) or 1.0
            belief[i] = [v / scale for v in own]
            out[i] = belief[i][CONTENT]
        return out

    def main_text(self, source: str) -> str:
        tree = Tree(source)
        return tree.kept([p > 0.5 for p in self.marginals(tree)])


def count_labels(source: str) -> dict[tuple[str, int, int], float]:
    tree = Tree(source)
    state = tree.labels()
    out: dict[tuple[str, int, int], float] = {}
    if state is None:
        return out
    for i, names in enumerate(tree.features()):
        for name in names:
            key = (name, state[i], 0)
            out[key] = out.get(key, 0.0) + 1
        if i:
            key = ("pair:text" if tree.tag[i] is None else "pair:element", state[i], state[tree.parent[i]])
            out[key] = out.get(key, 0.0) + 1
    return out


def _inputs(pages: DataFrame, html_col: str, *columns) -> DataFrame:
    return pages.select(*columns, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 3000) -> Model:
    """Potentials from at most `max_pages` labelled pages; the counts are summed by Spark."""

    prepare(pages.sparkSession)
    marked = _inputs(pages, html_col, F.col(id_col).alias("id")).filter(F.lower("html").rlike("<(article|main)"))
    order = F.xxhash64(F.col("id").cast("string"))
    # Ids first: only they go through the ordering, then the chosen pages are read.
    chosen = marked.select("id").distinct().orderBy(order, F.col("id").cast("string")).limit(max_pages)
    ids = pages.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    sample = marked.join(F.broadcast(ids), "id").select("html")

    def work(cols):
        sums: dict = {}
        for source in cols["html"]:
            for key, n in count_labels(source).items():
                sums[key] = sums.get(key, 0.0) + n
        return {
            "name": [k[0] for k in sums],
            "state": [k[1] for k in sums],
            "parent": [k[2] for k in sums],
            "n": list(sums.values()),
        }

    counts = map_rows(sample, "name string, state int, parent int, n double", work)
    rows = counts.groupBy("name", "state", "parent").agg(F.sum("n").alias("n")).collect()
    return Model({(r["name"], r["state"], r["parent"]): r["n"] for r in rows})


def extract(
    pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """`id`, `url` and `text` (main text); one row per input row."""

    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((model.unary, model.pair))
    source = _inputs(pages, html_col, F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))

    def work(cols):
        own = Model.__new__(Model)
        own.unary, own.pair = shared.value
        return {"id": cols["id"], "url": cols["url"], "text": [own.main_text(h) for h in cols["html"]]}

    return map_rows(source, f"id {id_type(pages, id_col)}, url string, text string", work)
