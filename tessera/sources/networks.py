"""Text formats of discrete networks: XMLBIF, UAI, NET, XBN, XDSL, PomdpX, plain XML, and CSV of structure and tables.

Each reads a text to a :class:`Network` and writes one. XML is refused beyond a
size, and so are document types, which could name other files.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

from tessera.sources.files import Network

#: Bytes of an XML text that are read at most, unless a caller says otherwise.
XML_LIMIT = 64 << 20


def _root(text: str, limit: int) -> ET.Element:
    if len(text.encode()) > limit:
        raise ValueError("larger than the limit")
    if re.search(r"<!DOCTYPE[^>\[]*(SYSTEM|PUBLIC)|<!ENTITY", text):
        raise ValueError("outside references are not read")
    return ET.fromstring(text)


def _configurations(net_states: dict[str, list[str]], parents: Sequence[str]) -> list[tuple[str, ...]]:
    return list(itertools.product(*[net_states[p] for p in parents]))


def _rows(states: dict[str, list[str]], child: str, parents: Sequence[str], numbers: Sequence[float]) -> dict[tuple, list[float]]:
    """Numbers with the child fastest, configurations of parents in order."""
    n = len(states[child])
    return {key: [float(x) for x in numbers[k * n : (k + 1) * n]] for k, key in enumerate(_configurations(states, parents))}


def _numbers(net: Network, child: str) -> list[float]:
    parents, rows = net.tables[child]
    return [p for key in _configurations(net.states, parents) for p in rows[key]]


def _text(values: Sequence[float]) -> str:
    return " ".join(repr(float(v)) for v in values)


def read_xmlbif(text: str, limit: int = XML_LIMIT) -> Network:
    root = _root(text, limit)
    states = {v.findtext("NAME").strip(): [o.text.strip() for o in v.iter("OUTCOME")] for v in root.iter("VARIABLE")}
    tables = {}
    for d in root.iter("DEFINITION"):
        child, parents = d.findtext("FOR").strip(), [g.text.strip() for g in d.findall("GIVEN")]
        tables[child] = (parents, _rows(states, child, parents, [float(x) for x in d.findtext("TABLE").split()]))
    return Network(states, tables)


def write_xmlbif(net: Network) -> str:
    root = ET.Element("BIF", VERSION="0.3")
    body = ET.SubElement(root, "NETWORK")
    ET.SubElement(body, "NAME").text = "network"
    for v, s in net.states.items():
        e = ET.SubElement(body, "VARIABLE", TYPE="nature")
        ET.SubElement(e, "NAME").text = v
        for x in s:
            ET.SubElement(e, "OUTCOME").text = x
    for v, (parents, _) in net.tables.items():
        e = ET.SubElement(body, "DEFINITION")
        ET.SubElement(e, "FOR").text = v
        for p in parents:
            ET.SubElement(e, "GIVEN").text = p
        ET.SubElement(e, "TABLE").text = _text(_numbers(net, v))
    return ET.tostring(root, encoding="unicode")


def read_uai(text: str) -> Network:
    """A ``BAYES`` file; variables are X0, X1, ..., states 0, 1, ...; a table's last variable is its child."""
    words = iter(text.split())
    if next(words) != "BAYES":
        raise ValueError("only BAYES files hold a directed network")
    sizes = [int(next(words)) for _ in range(int(next(words)))]
    states = {f"X{k}": [str(s) for s in range(n)] for k, n in enumerate(sizes)}
    scopes = [[f"X{next(words)}" for _ in range(int(next(words)))] for _ in range(int(next(words)))]
    tables = {}
    for *parents, child in scopes:
        numbers = [float(next(words)) for _ in range(int(next(words)))]
        tables[child] = (parents, _rows(states, child, parents, numbers))
    return Network(states, tables)


def write_uai(net: Network) -> str:
    place = {v: k for k, v in enumerate(net.states)}
    lines = ["BAYES", str(len(place)), " ".join(str(len(s)) for s in net.states.values()), str(len(net.tables))]
    lines += [" ".join(map(str, [len(ps) + 1, *[place[p] for p in ps], place[v]])) for v, (ps, _) in net.tables.items()]
    for v in net.tables:
        numbers = _numbers(net, v)
        lines += ["", str(len(numbers)), _text(numbers)]
    return "\n".join(lines) + "\n"


def read_net(text: str) -> Network:
    """Node and potential blocks."""
    states = {name: re.findall(r'"([^"]*)"', re.search(r"states\s*=\s*\(([^)]*)\)", body)[1]) for name, body in re.findall(r"node\s+(\w+)\s*\{(.*?)\}", text, re.S)}
    tables = {}
    for head, body in re.findall(r"potential\s*\(([^)]*)\)\s*\{(.*?)\}", text, re.S):
        child, _, given = head.partition("|")
        numbers = re.findall(r"[-+]?\d[\d.eE+-]*", re.search(r"data\s*=\s*([^;]*);", body)[1])
        parents = given.split()
        tables[child.strip()] = (parents, _rows(states, child.strip(), parents, [float(x) for x in numbers]))
    return Network(states, tables)


def _nested(states: dict[str, list[str]], parents: Sequence[str], child: str, numbers: list[float]) -> str:
    """Numbers in brackets, one pair for each axis."""
    sizes = [*[len(states[p]) for p in parents], len(states[child])]

    def part(k: int, values: list[float]) -> str:
        if k == len(sizes):
            return repr(values[0])
        step = len(values) // sizes[k]
        return "(" + " ".join(part(k + 1, values[i * step : (i + 1) * step]) for i in range(sizes[k])) + ")"

    return part(0, numbers)


def write_net(net: Network) -> str:
    out = ["net\n{\n}\n"]
    for v, s in net.states.items():
        names = " ".join(f'"{x}"' for x in s)
        out.append(f"node {v}\n{{\n  states = ({names});\n}}\n")
    for v, (parents, _) in net.tables.items():
        head = f"{v} | {' '.join(parents)}" if parents else v
        out.append(f"potential ({head})\n{{\n  data = {_nested(net.states, parents, v, _numbers(net, v))};\n}}\n")
    return "".join(out)


def read_xbn(text: str, limit: int = XML_LIMIT) -> Network:
    root = _root(text, limit)
    states = {v.get("NAME"): [s.text.strip() for s in v.iter("STATENAME")] for v in root.iter("VAR")}
    tables = {}
    for d in root.iter("DIST"):
        child = d.find("PRIVATE").get("NAME")
        parents = [c.get("NAME") for c in d.iter("CONDELEM")]
        numbers = [float(x) for p in d.iter("DPI") for x in p.text.split()]
        tables[child] = (parents, _rows(states, child, parents, numbers))
    return Network(states, tables)


def write_xbn(net: Network) -> str:
    root = ET.Element("ANALYSISNOTEBOOK")
    body = ET.SubElement(root, "BNMODEL", NAME="network")
    variables = ET.SubElement(body, "VARIABLES")
    for v, s in net.states.items():
        e = ET.SubElement(variables, "VAR", NAME=v, TYPE="discrete")
        for x in s:
            ET.SubElement(e, "STATENAME").text = x
    links = ET.SubElement(body, "STRUCTURE")
    for a, b in net.edges():
        ET.SubElement(links, "ARC", PARENT=a, CHILD=b)
    tables = ET.SubElement(body, "DISTRIBUTIONS")
    for v, (parents, rows) in net.tables.items():
        e = ET.SubElement(tables, "DIST", TYPE="discrete")
        if parents:
            given = ET.SubElement(e, "CONDSET")
            for p in parents:
                ET.SubElement(given, "CONDELEM", NAME=p)
        ET.SubElement(e, "PRIVATE", NAME=v)
        cells = ET.SubElement(e, "DPIS")
        for key in _configurations(net.states, parents):
            at = {"INDEXES": " ".join(str(net.states[p].index(s)) for p, s in zip(parents, key, strict=True))} if parents else {}
            ET.SubElement(cells, "DPI", **at).text = _text(rows[key])
    return ET.tostring(root, encoding="unicode")


def read_xdsl(text: str, limit: int = XML_LIMIT) -> Network:
    root = _root(text, limit)
    states = {c.get("id"): [s.get("id") for s in c.findall("state")] for c in root.iter("cpt")}
    tables = {}
    for c in root.iter("cpt"):
        parents = (c.findtext("parents") or "").split()
        tables[c.get("id")] = (parents, _rows(states, c.get("id"), parents, [float(x) for x in c.findtext("probabilities").split()]))
    return Network(states, tables)


def write_xdsl(net: Network) -> str:
    root = ET.Element("smile", version="1.0", id="network")
    body = ET.SubElement(root, "nodes")
    for v, (parents, _) in net.tables.items():
        e = ET.SubElement(body, "cpt", id=v)
        for s in net.states[v]:
            ET.SubElement(e, "state", id=s)
        if parents:
            ET.SubElement(e, "parents").text = " ".join(parents)
        ET.SubElement(e, "probabilities").text = _text(_numbers(net, v))
    return ET.tostring(root, encoding="unicode")


def read_pomdpx(text: str, limit: int = XML_LIMIT) -> Network:
    """State variables and their conditional tables; entries name every instance, ``-`` stands for the child's states in turn."""
    root = _root(text, limit)
    states = {v.get("vnamePrev") or v.get("vname"): v.findtext("ValueEnum").split() for v in root.iter("StateVar")}
    tables: dict[str, tuple[list[str], dict[tuple, list[float]]]] = {}
    for c in root.iter("CondProb"):
        child, given = c.findtext("Var").strip(), [p for p in (c.findtext("Parent") or "").split() if p != "null"]
        rows = {}
        for e in c.iter("Entry"):
            *key, last = e.findtext("Instance").split()
            if last != "-":
                raise ValueError("entries name the child's states one by one")
            rows[tuple(key)] = [float(x) for x in e.findtext("ProbTable").split()]
        tables[child] = (given, rows)
    return Network(states, tables)


def write_pomdpx(net: Network) -> str:
    root = ET.Element("pomdpx", version="1.0")
    variables = ET.SubElement(root, "Variable")
    for v, s in net.states.items():
        e = ET.SubElement(variables, "StateVar", vnamePrev=v)
        ET.SubElement(e, "ValueEnum").text = " ".join(s)
    body = ET.SubElement(root, "InitialStateBelief")
    for v, (parents, rows) in net.tables.items():
        c = ET.SubElement(body, "CondProb")
        ET.SubElement(c, "Var").text = v
        ET.SubElement(c, "Parent").text = " ".join(parents) or "null"
        cells = ET.SubElement(c, "Parameter", type="TBL")
        for key in _configurations(net.states, parents):
            e = ET.SubElement(cells, "Entry")
            ET.SubElement(e, "Instance").text = " ".join([*key, "-"])
            ET.SubElement(e, "ProbTable").text = _text(rows[key])
    return ET.tostring(root, encoding="unicode")


def read_xml(text: str, limit: int = XML_LIMIT) -> Network:
    """The library's own XML."""
    root = _root(text, limit)
    states = {v.get("name"): [s.text or "" for s in v.findall("state")] for v in root.iter("variable")}
    tables = {}
    for t in root.iter("table"):
        parents = [p.text for p in t.findall("parent")]
        rows = {tuple(g.text or "" for g in r.findall("given")): [float(x) for x in r.findtext("p").split()] for r in t.findall("row")}
        tables[t.get("of")] = (parents, rows)
    return Network(states, tables)


def write_xml(net: Network) -> str:
    root = ET.Element("network")
    for v, s in net.states.items():
        e = ET.SubElement(root, "variable", name=v)
        for x in s:
            ET.SubElement(e, "state").text = x
    for v, (parents, rows) in net.tables.items():
        t = ET.SubElement(root, "table", of=v)
        for p in parents:
            ET.SubElement(t, "parent").text = p
        for key, ps in rows.items():
            r = ET.SubElement(t, "row")
            for g in key:
                ET.SubElement(r, "given").text = g
            ET.SubElement(r, "p").text = _text(ps)
    return ET.tostring(root, encoding="unicode")


def write_csv_structure(net: Network) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("parent", "child"), *net.edges()])
    return out.getvalue()


def read_csv_structure(text: str) -> list[tuple[str, str]]:
    return [(r["parent"], r["child"]) for r in csv.DictReader(io.StringIO(text))]


def write_csv_cpd(net: Network, variable: str) -> str:
    """A row for each configuration of parents, a column for each state."""
    parents, rows = net.tables[variable]
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n").writerow
    write([*parents, *[f"{variable}={s}" for s in net.states[variable]]])
    for key, p in rows.items():
        write([*key, *map(repr, p)])
    return out.getvalue()


def read_csv_cpd(text: str) -> tuple[str, list[str], list[str], dict[tuple, list[float]]]:
    """Variable, its states, parents and rows."""
    lines: Iterator[list[str]] = csv.reader(io.StringIO(text))
    head = next(lines)
    first = next(k for k, h in enumerate(head) if "=" in h)
    variable = head[first].split("=", 1)[0]
    return variable, [h.split("=", 1)[1] for h in head[first:]], head[:first], {tuple(r[:first]): [float(x) for x in r[first:]] for r in lines if r}


FORMATS = {"xmlbif": (read_xmlbif, write_xmlbif), "uai": (read_uai, write_uai), "net": (read_net, write_net), "xbn": (read_xbn, write_xbn), "xdsl": (read_xdsl, write_xdsl), "pomdpx": (read_pomdpx, write_pomdpx), "xml": (read_xml, write_xml)}
