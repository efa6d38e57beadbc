"""A neighbourhood as one self-contained HTML page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.lookup import k_hop

_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><svg id="g" width="960" height="720"></svg><script>
const d={data},g=document.getElementById("g"),n=d.nodes.length,ns="http://www.w3.org/2000/svg";
const at=i=>{{const r=90*d.nodes[i].hops+(d.nodes[i].hops?20:0),a=i*2.399963;return[480+r*Math.cos(a),360+r*Math.sin(a)]}};
const add=(t,o)=>{{const e=document.createElementNS(ns,t);for(const k in o)e.setAttribute(k,o[k]);g.appendChild(e);return e}};
for(const[a,b,t]of d.edges){{const[x,y]=at(a),[u,v]=at(b);add("line",{{x1:x,y1:y,x2:u,y2:v,stroke:"#999"}}).appendChild(document.createElementNS(ns,"title")).textContent=t}}
for(let i=0;i<n;i++){{const[x,y]=at(i);add("circle",{{cx:x,cy:y,r:5,fill:"#36c"}});add("text",{{x:x+7,y:y+4,"font-size":11}}).textContent=d.nodes[i].name}}
</script>"""


def subgraph(relations: DataFrame, namespace: str, entity_type: str, name: str, depth: int = 2, max_nodes: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around an entity; max_nodes is what one picture shows, nearest first."""
    nodes = k_hop(relations, namespace, entity_type, name, depth).orderBy("hops", "entity_type", "normalized_name").limit(max_nodes)
    ends = nodes.select("entity_type", "normalized_name")
    edges = relations.filter(F.col("namespace") == namespace).join(ends.toDF("src_type", "src_norm"), ["src_type", "src_norm"], "left_semi").join(ends.toDF("dst_type", "dst_norm"), ["dst_type", "dst_norm"], "left_semi")
    return nodes, edges.select("src_type", "src_norm", "rel_type", "dst_type", "dst_norm")


def render(relations: DataFrame, namespace: str, entity_type: str, name: str, depth: int = 2, max_nodes: int = 100) -> str:
    nodes, edges = subgraph(relations, namespace, entity_type, name, depth, max_nodes)
    rows = [(r.entity_type, r.normalized_name, r.hops) for r in nodes.collect()]  # at most max_nodes
    at = {(t, n): k for k, (t, n, _) in enumerate(rows)}
    lines = [(at[r.src_type, r.src_norm], at[r.dst_type, r.dst_norm], r.rel_type) for r in edges.collect() if (r.src_type, r.src_norm) in at and (r.dst_type, r.dst_norm) in at]
    data = json.dumps({"nodes": [{"type": t, "name": n, "hops": h} for t, n, h in rows], "edges": lines}).replace("</", "<\\/")
    return _PAGE.format(title=html.escape(f"{entity_type}: {name}"), data=data)
