"""One HTML page: a treemap of files by lines, coloured by maintainability, and the require graph."""

from __future__ import annotations

import json

_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>Project map</title><style>body{font:13px sans-serif;margin:16px}#m{display:flex;flex-wrap:wrap}
#m div{margin:1px;padding:4px;overflow:hidden;color:#fff;min-width:40px}</style></head><body><h1>Files</h1><div id="m"></div><h1>Requires</h1><svg id="g" width="800" height="800"></svg>
<script>const d=__DATA__;for(const n of d.nodes){const e=document.createElement('div');const s=Math.max(24,Math.sqrt(n.lines)*8);e.style.width=s+'px';e.style.height=s+'px';
e.style.background=n.mi===null?'#888':`hsl(${n.mi*1.2},60%,40%)`;e.title=`${n.path}: ${n.lines} lines, ${n.mi}`;e.textContent=n.path;m.append(e)}
const P={};d.nodes.forEach((n,i)=>{const a=2*Math.PI*i/d.nodes.length;P[n.path]=[400+340*Math.cos(a),400+340*Math.sin(a)]});
const S=(t,o)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',t);for(const k in o)e.setAttribute(k,o[k]);g.append(e);return e};
for(const [a,b] of d.edges)if(P[a]&&P[b])S('line',{x1:P[a][0],y1:P[a][1],x2:P[b][0],y2:P[b][1],stroke:'#999'});for(const p in P)S('text',{x:P[p][0],y:P[p][1],'font-size':10}).textContent=p;</script></body></html>"""


def render(project) -> str:
    from pyspark.sql import functions as F

    h = project.health()["file_scores"].select("path", F.col("maintainability_index").alias("mi"))
    nodes = project.files.select("path", "lines").join(h, "path", "left").orderBy("path")
    edges = project.links.orderBy("src", "dst")
    data = {"nodes": [r.asDict() for r in nodes.toLocalIterator()], "edges": [list(r) for r in edges.toLocalIterator()]}
    return _PAGE.replace("__DATA__", json.dumps(data).replace("</", "<\\/"))
