"""Category and benign flag of a wait type by rule (SD-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wait types whose category does not follow from their beginning.
EXACT = [
    ("SOS_SCHEDULER_YIELD", "CPU"), ("THREADPOOL", "Worker Thread"), ("RESOURCE_SEMAPHORE_QUERY_COMPILE", "Compilation"),
    ("RESOURCE_SEMAPHORE", "Memory"), ("CMEMTHREAD", "Memory"), ("CMEMPARTITIONED", "Memory"), ("EE_PMOLOCK", "Memory"),
    ("MEMORY_ALLOCATION_EXT", "Memory"), ("MEMORY_GRANT_UPDATE", "Memory"), ("RESERVED_MEMORY_ALLOCATION_EXT", "Memory"),
    ("ASYNC_NETWORK_IO", "Network IO"), ("NET_WAITFOR_PACKET", "Network IO"), ("EXTERNAL_SCRIPT_NETWORK_IOF", "Network IO"),
    ("ASYNC_IO_COMPLETION", "Other Disk IO"), ("BACKUPIO", "Other Disk IO"), ("IO_COMPLETION", "Other Disk IO"),
    ("IO_QUEUE_LIMIT", "Other Disk IO"), ("IO_RETRY", "Other Disk IO"), ("WRITE_COMPLETION", "Other Disk IO"),
    ("CXPACKET", "Parallelism"), ("CXCONSUMER", "Parallelism"), ("EXCHANGE", "Parallelism"), ("WAIT_FOR_RESULTS", "User Wait"), ("WAITFOR", "User Wait"), ("BROKER_RECEIVE_WAITFOR", "User Wait"),
    ("LOG_RATE_GOVERNOR", "Tran Log IO"), ("CHKPT", "Tran Log IO"), ("WRITELOG", "Tran Log IO"), ("LOGMGR_QUEUE", "Idle"),
    ("HADR_THROTTLE_LOG_RATE_GOVERNOR", "Log Rate Governor"), ("INSTANCE_LOG_RATE_GOVERNOR", "Log Rate Governor"),
    ("POOL_LOG_RATE_GOVERNOR", "Log Rate Governor"), ("CHECKPOINT_QUEUE", "Idle"), ("LAZYWRITER_SLEEP", "Idle"),
    ("ONDEMAND_TASK_QUEUE", "Idle"), ("POPULATE_LOCK_ORDINALS", "Idle"), ("REQUEST_FOR_DEADLOCK_SEARCH", "Idle"),
    ("FT_IFTS_SCHEDULER_IDLE_WAIT", "Idle"), ("SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "Idle"),
    ("SQLTRACE_BUFFER_FLUSH", "Idle"), ("SQLTRACE_WAIT_ENTRIES", "Idle"), ("SOS_WORK_DISPATCHER", "Idle"), ("XE_DISPATCHER_WAIT", "Idle"),
    ("XE_TIMER_EVENT", "Idle"), ("FULLTEXT GATHERER", "Full Text Search"), ("MSSEARCH", "Full Text Search"),
    ("PWAIT_RESOURCE_SEMAPHORE_FT_PARALLEL_QUERY_SYNC", "Full Text Search"), ("DIRTY_PAGE_TABLE_LOCK", "Replication"),
    ("DPT_ENTRY_LOCK", "Replication"), ("REPLICA_WRITES", "Replication"), ("TRANSACTION_MUTEX", "Transaction"),
]
# Beginnings of the other categories, the first that fits.
BEGINNINGS = [
    ("LCK_M_", "Lock"), ("PAGEIOLATCH_", "Buffer IO"), ("PAGELATCH_", "Buffer Latch"), ("LATCH_", "Latch"),
    ("LOGMGR", "Tran Log IO"), ("LOGBUFFER", "Tran Log IO"), ("HADR_", "Replication"), ("REPL_", "Replication"), ("FCB_REPLICA_", "Replication"),
    ("PARALLEL_REDO_", "Replication"), ("PWAIT_HADR", "Replication"), ("MSQL_XACT", "Transaction"),
    ("DBMIRROR", "Mirroring"), ("PREEMPTIVE_", "Preemptive"), ("CLR", "SQL CLR"), ("SQLCLR", "SQL CLR"), ("BROKER_", "Service Broker"),
    ("FT_", "Full Text Search"), ("DTC", "Transaction"), ("TRAN_", "Transaction"), ("XACT", "Transaction"), ("SLEEP_", "Idle"),
    ("SQLTRACE_", "Tracing"), ("TRACE", "Tracing"), ("QUERY_TRACEOUT", "Tracing"),
]
# Waits that say nothing about load.
BENIGN = [
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH", "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE",
    "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT", "CLR_SEMAPHORE", "DBMIRRORING_CMD", "DBMIRROR_DBM_EVENT", "DBMIRROR_DBM_MUTEX",
    "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "FT_IFTSHC_MUTEX", "FT_IFTSISM_MUTEX",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "HADR_CLUSAPI_CALL", "HADR_FABRIC_CALLBACK", "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT",
    "HADR_NOTIFICATION_DEQUEUE", "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE", "ONDEMAND_TASK_QUEUE",
    "PARALLEL_REDO_DRAIN_WORKER", "PARALLEL_REDO_LOG_CACHE", "PARALLEL_REDO_TRAN_LIST", "PARALLEL_REDO_TRAN_TURN", "PARALLEL_REDO_WORKER_SYNC",
    "PARALLEL_REDO_WORKER_WAIT_WORK", "POPULATE_LOCK_ORDINALS", "PREEMPTIVE_HADR_LEASE_MECHANISM", "PREEMPTIVE_SP_SERVER_DIAGNOSTICS",
    "PREEMPTIVE_XE_DISPATCHER", "QDS_ASYNC_QUEUE", "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_SHUTDOWN_QUEUE", "REDO_THREAD_PENDING_WORK", "REQUEST_FOR_DEADLOCK_SEARCH", "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SOS_WORK_DISPATCHER",
    "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP", "UCS_SESSION_REGISTRATION", "WAITFOR",
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "XE_DISPATCHER_WAIT", "XE_LIVE_TARGET_TVF", "XE_TIMER_EVENT",
]


def wait_category(wait: Column, default: str = "Other") -> Column:
    out = F.lit(default)
    for start, category in reversed(BEGINNINGS):
        out = F.when(wait.startswith(start), category).otherwise(out)
    exact: dict[str, list[str]] = {}
    for name, category in EXACT:
        exact.setdefault(category, []).append(name)
    for category, names in exact.items():
        out = F.when(wait.isin(names), category).otherwise(out)
    return out


def is_benign(wait: Column) -> Column:
    return F.coalesce(wait.isin(BENIGN), F.lit(False))
