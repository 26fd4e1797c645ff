"""turnlake: analytics over logs of repeated two-player games, as Spark DataFrame jobs.

Layers: paired decisions -> bronze (one row per match, turn and seat) -> silver (what the
player could know at each turn) -> gold (fact, dimension, marts) -> report.
"""
