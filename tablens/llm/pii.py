"""Operator 2, personal data by a skip-chain conditional random field.

Patterns find the base spans. Every token that holds a digit or ``@`` is a node; its label is one
of the four kinds or nothing. Nodes have a linear model over their form (unary potentials),
neighbouring nodes share chain potentials, and distant nodes of a document that repeat a token
(same address, same digits) or end in the same seven digits share skip potentials. Loopy
sum-product passes messages over both kinds of edges; base findings are observed labels. A token
that the patterns leave alone is added when its belief in a kind reaches ``added_from`` through
what its repetitions are labelled.

The potentials are trained piecewise on the patterns' labels: label pairs along edges are counted over
all documents, the unary model is fitted on a bounded sample of tokens (``fit_tokens``).
Repeated tokens are tied along one chain in text order, and for the labelling also to a labelled repeat, so a
label is one edge from every repeat however many there are and a document's edges grow with its tokens. Each
document's messages are passed until they settle.

Null and empty texts give no spans. Repeated rows get equal results. An empty table gives no rows. Texts
are read whole. ``find_personal_data`` keeps only the columns it is told to keep.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1         # 0: nothing
FIT_TOKENS, ADDED_FROM, ROUNDS, DAMPING, SETTLED = 50_000, 0.9, 12, 0.5, 1e-4
EDGE_KINDS = ("chain", "same", "suffix")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_DIGITS = re.compile(r"[^0-9]+")
_OPEN, _CLOSE = "([{<\"'", ".,;:!?)]}>\"'#$%&*"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), leftmost and non-overlapping per kind, sorted by start, then kind."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _DIGITS.sub("", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def nodes_of(text: str, spans) -> list[tuple[int, int, str, int]]:
    """(start, end, token, observed label) of tokens with a digit or ``@``, trimmed of punctuation."""
    out, k = [], 0
    for m in _NODE.finditer(text):
        raw = m.group()
        tok = raw.lstrip(_OPEN)
        start = m.end() - len(tok)
        tok = tok.rstrip(_CLOSE)
        if not tok:
            continue
        end = start + len(tok)
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        label = next((kind + 1 for s, kind, e in spans[k:k + 4] if s < end and e > start), 0)
        out.append((start, end, tok, label))
    return out


def node_features(tok: str) -> np.ndarray:
    d = sum(48 <= ord(c) <= 57 for c in tok)
    n = len(tok)
    dots, dashes = tok.count("."), tok.count("-")
    x = np.zeros(24, np.float32)
    x[min(d, 17)] = 1           # number of digits, 17 for more
    x[18] = d / n
    x[19] = "@" in tok
    x[20] = tok.startswith("+")
    x[21] = min(dots, 4) / 4
    x[22] = min(dashes, 4) / 4
    x[23] = 1
    return x


def _ties(tok: str) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
    """What a token shares with its repeats, and with tokens of the same last seven digits."""
    d = _DIGITS.sub("", tok)
    key = ("=", d) if len(d) >= 5 and "@" not in tok else ("@", tok.lower()) if "@" in tok else None
    return key, ("..", d[-7:]) if len(d) >= 7 and "@" not in tok else None


def edges_of(nodes) -> list[tuple[int, int, int]]:
    """(node, later node, edge kind). Neighbours within four characters chain; equal tokens and equal
    last seven digits tie each node to the latest one before it."""
    out, last = [], {}
    for i, (start, _, tok, _) in enumerate(nodes):
        if i and start - nodes[i - 1][1] <= 4:
            out.append((i - 1, i, 0))
        key, tail = _ties(tok)
        same = last.get(key) if key else None
        near = last.get(tail) if tail else None
        if same is not None:
            out.append((same, i, 1))
        if near is not None and near != same:
            out.append((near, i, 2))
        for k in (key, tail):
            if k:
                last[k] = i
    return out


def with_labelled(nodes, edges) -> list[tuple[int, int, int]]:
    """``edges``, and one from each unlabelled node to the labelled repeat nearest before it, else the first
    after it, so that a label is one edge from every repeat. Labelled nodes are observed: no loops arise."""
    out, known = list(edges), {(a, b) for a, b, _ in edges}
    ties = [_ties(tok) for _, _, tok, _ in nodes]
    for which in (0, 1):
        at: dict[tuple[str, str], int] = {}
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i][3] and ties[i][which]:
                at[ties[i][which]] = i
        for i, both in enumerate(ties):
            j = at.get(both[which])
            if j is None:
                continue
            if nodes[i][3]:
                at[both[which]] = i
            elif (min(i, j), max(i, j)) not in known and not (which and both[0] and both[0] == ties[j][0]):
                out.append((min(i, j), max(i, j), which + 1))
    return out


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """Marginals by loopy sum-product in logs. ``unary`` (nodes, labels); ``edges`` (a, b, kind);
    ``pair`` (kinds, labels, labels) from an earlier node's label to a later one's; ``owner`` the document
    of each node. Every document goes on until its messages settle. A damped message moves on a hop in two
    rounds, so four rounds for each edge reach all of a document; messages that still swing then are left."""
    n, e = len(unary), len(edges)
    norm = lambda z: z - np.logaddexp.reduce(z, axis=-1, keepdims=True)
    if not e:
        return np.exp(norm(unary))
    doc = np.zeros(e, np.int64) if owner is None else owner[edges[:, 0]]
    bound = ROUNDS + 4 * np.bincount(doc)
    msg = np.zeros((2, e, unary.shape[1]))      # to the later node, to the earlier one
    live, rounds = np.arange(e), 0
    while len(live):
        m = len(live)
        nodes, ends = np.unique(edges[live, :2], return_inverse=True)
        a, b = ends.reshape(m, 2).T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        table = pair[edges[live, 2]]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        own, now = unary[nodes], msg[:, live].reshape(2 * m, -1)
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, dst, now)
            out = norm(np.logaddexp.reduce((total[src] - now[back])[:, :, None] + table, axis=1))
            moved = np.abs(out - now).max(axis=1)
            now = DAMPING * now + (1 - DAMPING) * out
            if moved.max() < SETTLED:
                break
        rounds += ROUNDS
        msg[:, live] = now.reshape(2, m, -1)
        moving = np.zeros(len(bound), bool)
        moving[doc[live[np.maximum(moved[:m], moved[m:]) >= SETTLED]]] = True
        live = live[moving[doc[live]] & (rounds < bound[doc[live]])]
    total = unary.copy()
    np.add.at(total, edges[:, 1], msg[0])
    np.add.at(total, edges[:, 0], msg[1])
    return np.exp(norm(total))


def train(docs: DataFrame, text_col: str, fit_tokens: int = FIT_TOKENS) -> dict:
    """Edge tables from label pairs counted over all documents; unary weights by softmax regression on
    about ``fit_tokens`` tokens, picked by the token's own hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = np.zeros((len(EDGE_KINDS), LABELS, LABELS), np.int64)
            forms: dict[tuple[int, bytes], int] = {}
            for t in pdf["text"]:
                if not t:
                    continue
                nodes = nodes_of(t, base_spans(t))
                for a, b, k in edges_of(nodes):
                    pairs[k, nodes[a][3], nodes[b][3]] += 1
                for _, _, tok, label in nodes:
                    f = (label, node_features(tok).tobytes())
                    forms[f] = forms.get(f, 0) + 1
            rows = [("p%d" % i, None, int(n)) for i, n in enumerate(pairs.ravel()) if n]
            rows += [("u%d" % lab, x, n) for (lab, x), n in forms.items()]
            yield pd.DataFrame(rows, columns=["what", "x", "n"])

    counts = (docs.select(F.col(text_col).alias("text")).mapInPandas(run, "what string, x binary, n long")
              .groupBy("what", "x").agg(F.sum("n").alias("n")))
    counts = durable(counts)
    pairs = np.zeros(len(EDGE_KINDS) * LABELS * LABELS)
    for r in counts.where("what like 'p%'").collect():      # at most kinds * labels^2 rows
        pairs[int(r["what"][1:])] = r["n"]
    pairs = pairs.reshape(len(EDGE_KINDS), LABELS, LABELS) + 0.5
    joint = pairs / pairs.sum(axis=(1, 2), keepdims=True)
    table = np.log(joint) - np.log(joint.sum(axis=2, keepdims=True)) - np.log(joint.sum(axis=1, keepdims=True))
    # distinct token forms with their counts: the most frequent ones, at most fit_tokens
    fit = counts.where("what like 'u%'").orderBy(F.desc("n"), "what", "x").limit(fit_tokens).collect()
    weights = np.zeros((24, LABELS))
    if fit:
        x = np.array([np.frombuffer(r["x"], np.float32) for r in fit], np.float64)
        y = np.eye(LABELS)[[int(r["what"][1:]) for r in fit]]
        w = np.sqrt(np.array([r["n"] for r in fit], float))     # damped, so that a hot form does not drown the others
        w /= w.sum()
        for _ in range(400):
            z = x @ weights
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            weights -= 1.5 * (x.T @ ((z - y) * w[:, None]) + 1e-4 * weights)
    return {"weights": weights, "table": table}


def added_spans(texts, bases, model: dict, added_from: float = ADDED_FROM) -> list[list[tuple[int, int, int]]]:
    """The spans the field adds to each text's base spans; all texts of the batch form one graph."""
    nodes, edges, owner = [], [], []
    for i, (t, base) in enumerate(zip(texts, bases)):
        mine = nodes_of(t, base) if t else []
        if not any(label for *_, label in mine):
            continue        # nothing observed that repetitions could carry on
        off = len(nodes)
        edges += [(a + off, b + off, k) for a, b, k in with_labelled(mine, edges_of(mine))]
        nodes += mine
        owner += [i] * len(mine)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not nodes:
        return out
    x = np.array([node_features(tok) for _, _, tok, _ in nodes], np.float64)
    unary = x @ model["weights"]
    seen = np.array([label for *_, label in nodes])
    fixed = np.full(LABELS, -1e9)       # no number of repeats outvotes an observed label
    unary[seen > 0] = fixed
    unary[seen > 0, seen[seen > 0]] = 0.0       # observed
    edges = np.array(edges, np.int64).reshape(-1, 3)
    belief = beliefs(unary, edges, model["table"], np.array(owner))
    tied = np.zeros(len(nodes), bool)
    skip = edges[:, 2] > 0
    tied[edges[skip, 0]] = tied[edges[skip, 1]] = True
    best = belief.argmax(axis=1)
    for j in np.nonzero(tied & (seen == 0) & (best > 0) & (belief.max(axis=1) >= added_from))[0]:
        out[owner[j]].append((nodes[j][0], int(best[j]) - 1, nodes[j][1]))
    return out


def find_personal_data(docs: DataFrame, keep: list[str], text_col: str = "text", model: dict | None = None) -> DataFrame:
    """``keep`` columns and base, added: array<struct<start, kind, end>> in code points."""
    model = model or train(docs, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.pop("__text")]
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, model)
            show = lambda spans: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]
            yield pdf.assign(base=[show(b) for b in bases], added=[show(a) for a in more])

    span = "array<struct<start:bigint,kind:string,end:bigint>>"
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInPandas(run, f"{kept}, base {span}, added {span}")


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    """Contract of query 2 over all of ``documents``; the counts are of the base spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs, ["doc_id"])
    place = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), place[s["kind"]].alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))))
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(join(F.col("base")), 256).alias("base_sha256"),
                        join(ordered).alias("spans"))
