"""A study as one self-contained page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import history

PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .8em;text-align:right}}svg{{border:1px solid #ccc}}</style>
<h1>{title}</h1><p>{line}</p><svg id="best" width="640" height="240"></svg><table id="t"></table>
<script>const model={model};
const ok=model.trials.filter(t=>t.best!==null);const xs=ok.map((_,i)=>i),ys=ok.map(t=>t.best);
const lo=Math.min(...ys),hi=Math.max(...ys),sx=620/Math.max(1,xs.length-1),sy=220/Math.max(1e-12,hi-lo);
document.getElementById("best").innerHTML='<polyline fill="none" stroke="#36c" points="'+xs.map(i=>(10+i*sx)+","+(230-(ys[i]-lo)*sy)).join(" ")+'"/>';
document.getElementById("t").innerHTML="<tr><th>trial<th>state<th>value<th>params</tr>"+model.trials.map(t=>"<tr><td>"+t.trial_id+"<td>"+t.state+"<td>"+(t.value??"")+"<td>"+Object.entries(t.params||{{}}).map(([k,v])=>k+"="+v).join(" ").replace(/</g,"&lt;")+"</tr>").join("");</script>"""


def model(trials: DataFrame, objective: str, direction: str) -> list[dict]:
    """A study's trials with values and the best so far, in order of id; a page shows them all."""
    best = history.best_so_far(trials, objective, direction).select("trial_id", "best")
    shown = F.map_from_entries(F.transform(F.map_entries("params"), lambda e: F.struct(e["key"], F.coalesce(e["value"]["s"], e["value"]["f"].cast("string"), e["value"]["i"].cast("string"), e["value"]["b"].cast("string")))))
    rows = trials.join(best, "trial_id", "left").select("trial_id", "state", history.final_value(objective).alias("value"), "best", shown.alias("params"))
    return [r.asDict(True) for r in rows.orderBy("trial_id").collect()]


def render(trials: DataFrame, objective: str, direction: str, title: str) -> str:
    line = history.summarize(trials).select("line").head()
    data = json.dumps({"trials": model(trials, objective, direction)}).replace("</", "<\\/")
    return PAGE.format(title=html.escape(title), line=html.escape(line[0] if line else "0 trials"), model=data)
