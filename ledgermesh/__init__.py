"""ledgermesh: multi-source record reconciliation as Spark DataFrame operators.

Entry points:

* ``ledgermesh.operators.idempotency.ingest_batch`` — envelopes -> records, DLQ, labels
* ``ledgermesh.operators.matching.reconcile`` — records -> per-ref decisions, details, audit
* ``ledgermesh.plans.batch.reconcile_batch`` / ``retrigger`` — one engine run over the tables
* ``ledgermesh.operators.resolution`` / ``retry`` — conflict resolution and the retry queue
* ``ledgermesh.streaming`` — streaming ingest, incremental and stateful matching, rate limiting
"""

__version__ = "0.1.0"
