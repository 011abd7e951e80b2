"""Vendor defaults of server and database options (DR-1, DR-2)."""

# Server option, default, check id.
CONFIG_DEFAULTS = [
    ("access check cache bucket count", 0, 1001), ("access check cache quota", 0, 1002), ("Ad Hoc Distributed Queries", 0, 1003),
    ("affinity I/O mask", 0, 1004), ("affinity mask", 0, 1005), ("affinity64 mask", 0, 1066), ("affinity64 I/O mask", 0, 1067),
    ("Agent XPs", 0, 1071), ("allow updates", 0, 1007), ("awe enabled", 0, 1008), ("backup checksum default", 0, 1070),
    ("backup compression default", 0, 1073), ("blocked process threshold", 0, 1009), ("blocked process threshold (s)", 0, 1009),
    ("c2 audit mode", 0, 1010), ("clr enabled", 0, 1011), ("common criteria compliance enabled", 0, 1074),
    ("contained database authentication", 0, 1068), ("cost threshold for parallelism", 5, 1012),
    ("cross db ownership chaining", 0, 1013), ("cursor threshold", -1, 1014), ("Database Mail XPs", 0, 1072),
    ("default full-text language", 1033, 1016), ("default language", 0, 1017), ("default trace enabled", 1, 1018),
    ("disallow results from triggers", 0, 1019), ("EKM provider enabled", 0, 1075), ("filestream access level", 0, 1076),
    ("fill factor (%)", 0, 1020), ("ft crawl bandwidth (max)", 100, 1021), ("ft crawl bandwidth (min)", 0, 1022),
    ("ft notify bandwidth (max)", 100, 1023), ("ft notify bandwidth (min)", 0, 1024), ("index create memory (KB)", 0, 1025),
    ("in-doubt xact resolution", 0, 1026), ("lightweight pooling", 0, 1027), ("locks", 0, 1028),
    ("max degree of parallelism", 0, 1029), ("max full-text crawl range", 4, 1030), ("max server memory (MB)", 2147483647, 1031),
    ("max text repl size (B)", 65536, 1032), ("max worker threads", 0, 1033), ("media retention", 0, 1034),
    ("min memory per query (KB)", 1024, 1035), ("nested triggers", 1, 1037), ("network packet size (B)", 4096, 1038),
    ("Ole Automation Procedures", 0, 1039), ("open objects", 0, 1040), ("optimize for ad hoc workloads", 0, 1041),
    ("PH timeout (s)", 60, 1042), ("precompute rank", 0, 1043), ("priority boost", 0, 1044),
    ("query governor cost limit", 0, 1045), ("query wait (s)", -1, 1046), ("recovery interval (min)", 0, 1047),
    ("remote access", 1, 1048), ("remote admin connections", 0, 1049), ("remote proc trans", 0, 1050),
    ("remote query timeout (s)", 600, 1051), ("Replication XPs", 0, 1052), ("RPC parameter data validation", 0, 1053),
    ("scan for startup procs", 0, 1054), ("server trigger recursion", 1, 1055), ("set working set size", 0, 1056),
    ("show advanced options", 0, 1057), ("SMO and DMO XPs", 1, 1058), ("SQL Mail XPs", 0, 1059),
    ("transform noise words", 0, 1060), ("two digit year cutoff", 2049, 1061), ("user connections", 0, 1062),
    ("user options", 0, 1063), ("Web Assistant Procedures", 0, 1064), ("xp_cmdshell", 0, 1065),
    ("automatic soft-NUMA disabled", 0, 269), ("external scripts enabled", 0, 269), ("clr strict security", 1, 269),
    ("column encryption enclave type", 0, 269), ("tempdb metadata memory-optimized", 0, 269),
    ("ADR cleaner retry timeout (min)", 15, 269), ("ADR Preallocation Factor", 4, 269),
    ("Data processed daily limit in TB", 2147483647, 269), ("Data processed weekly limit in TB", 2147483647, 269),
    ("Data processed monthly limit in TB", 2147483647, 269), ("ADR Cleaner Thread Count", 1, 269),
    ("hardware offload enabled", 0, 269), ("hardware offload config", 0, 269), ("hardware offload mode", 0, 269),
    ("backup compression algorithm", 0, 269), ("ADR cleaner lock timeout (s)", 5, 269), ("SLOG memory quota (%)", 75, 269),
    ("max RPC request params (KB)", 0, 269), ("max UCS send boxcars", 256, 269), ("availability group commit time (ms)", 0, 269),
    ("tiered memory enabled", 0, 269), ("max server tiered memory (MB)", 2147483647, 269), ("hadoop connectivity", 0, 269),
    ("polybase network encryption", 1, 269), ("remote data archive", 0, 269), ("allow polybase export", 0, 269),
    ("allow filesystem enumeration", 1, 269), ("polybase enabled", 0, 269), ("suppress recovery model errors", 0, 269),
    ("openrowset auto_create_statistics", 1, 269), ("external rest endpoint enabled", 0, 269),
    ("external xtp dll gen util enabled", 0, 269), ("external AI runtimes enabled", 0, 269),
    ("allow server scoped db credentials", 0, 269), ("min server memory (MB)", 0, 1036),
]

# Database option, default, check id, priority, finding.
DATABASE_DEFAULTS = [
    ("is_supplemental_logging_enabled", "0", 131, 210, "Supplemental Logging Enabled"),
    ("snapshot_isolation_state", "0", 132, 210, "Snapshot Isolation Enabled"),
    ("is_auto_create_stats_incremental_on", "0", 134, 210, "Auto Create Stats Incremental Enabled"),
    ("is_ansi_null_default_on", "0", 135, 210, "ANSI NULL Default Enabled"),
    ("is_recursive_triggers_on", "0", 136, 210, "Recursive Triggers Enabled"),
    ("is_trustworthy_on", "0", 137, 210, "Trustworthy Enabled"),
    ("is_broker_enabled", "0", 230, 210, "Broker Enabled"),
    ("is_honor_broker_priority_on", "0", 231, 210, "Honor Broker Priority Enabled"),
    ("is_parameterization_forced", "0", 138, 210, "Forced Parameterization Enabled"),
    ("is_query_store_on", "0", 139, 210, "Query Store Enabled"),
    ("is_cdc_enabled", "0", 140, 210, "Change Data Capture Enabled"),
    ("containment", "0", 141, 210, "Containment Enabled"),
    ("target_recovery_time_in_seconds", "0", 142, 210, "Target Recovery Time Changed"),
    ("delayed_durability", "0", 143, 210, "Delayed Durability Enabled"),
    ("is_memory_optimized_elevate_to_snapshot_on", "0", 144, 210, "Memory Optimized Enabled"),
    ("is_accelerated_database_recovery_on", "0", 145, 210, "Acclerated Database Recovery Enabled"),
]
