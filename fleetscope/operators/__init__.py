"""Operators: plain ``DataFrame -> DataFrame`` functions, grouped by family.

snapshots   SD-1..17  counter snapshot deltas, rates, wait reports
capacity    CAP-*, FC-1..3  sizes, growth, forecasts, file configuration
blocking    BLK-*     blocked sessions, chains (graph.resolve_roots), skew
graph       pointer jumping over parent edges, one-hop traversal
deadlocks   DL-*      shredding deadlock documents and the reports on them
querystats  QS-*, SD-12  query-store statistics, flags, regressions
plantree    one parse of a plan document into a flat operator array
plandocs    QS-3/7/8/9/10  plan-document features over that array
health      RL-1      health rules of databases, files, servers and the agent
catalog     IX-*      index / statistics / column catalog rules
backups     BK-*      throughput, RPO/RTO, recovery points, rules, restore plans
rules       RL-*      single-scan rule engine, skip lists, summaries
drift       DR-*, FC-4..7  configuration drift, version support, fleet rules
security    SEC-*, PRJ-7   permissions, role closure, orphans, row-level security
quality     DQ-*      profiles, orphan rows, table compare, inventory
documents   DOC-*, PRJ-6, QS-14, SRC-6  JSON, statement text, classification
vectors     VEC-*     distances, top-k search
relational  JN/AG/WN building blocks: as-of and range joins, bucketed lag /
            carry / row number, dynamic pivot, pruned global rank
findings    shaping rows into FINDING_SCHEMA
"""
