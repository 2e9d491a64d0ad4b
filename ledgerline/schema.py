"""Schemas of records, written out; nothing is inferred.

Maps stay maps, parameters and notes stay variants, times stay text (they are compared as
text), and what a record leaves out is null.
"""

from __future__ import annotations

IO_ENTRY = (
    "struct<path:string,sha256:string,content_sha256:string,sha256_tree:string,sha256_tree_casefolded:string,kind:string,symlink:boolean,symlink_target:string,size_bytes:bigint,"
    "mtime_utc:string,digested:boolean,note:string,unstable_during_hash:boolean,changed_after_registration:string,n_files:bigint,header:array<string>>"
)
RECORD = f"""
schema string, prev string, script string, run_uid string, run_id string, generation string, status string, failure struct<type:string,message:string,traceback:string>,
started_utc string, finished_utc string, command string, cwd string, parameters variant, notes variant, seeds array<bigint>,
observation struct<steps:string,auto_backend:string,auto_mode:string,auto_refused:string,packages_recorded:string,auto_available:boolean,unregistered_watch_truncated:bigint,steps_truncated:bigint,observed_truncated:bigint,auto_stopped_after_calls:bigint>,
tool struct<name:string,version:string,source:string,commit:string,url:string,dirty:boolean,identifies_code:boolean>,
resources struct<wall_seconds:double,cpu_seconds:double,max_rss_bytes:bigint,max_vms_bytes:bigint,io_read_bytes:bigint,io_write_bytes:bigint,source:string,unavailable:array<string>,io_self_only:boolean>,
steps variant, git_commit string, git_code_dirty boolean, git_tree_dirty boolean, git_status_captured boolean, tools map<string,string>, packages map<string,string>,
imported_code struct<count:bigint,digest:string,omitted:bigint>,
environment_snapshot struct<path:string,sha256:string,python:string,error:string,package_sets_unavailable:string,package_sets:map<string,string>,n_packages:bigint,n_unreadable:bigint,n_conda_packages:bigint,reused:boolean,lockfiles:array<struct<name:string,sha256:string,bytes:bigint,path:string,archived:boolean,error:string>>>,
inputs array<{IO_ENTRY}>, outputs array<{IO_ENTRY}>, provenance_path string, provenance_sha256 string, script_file string, project_source string, history_destination string,
terminal_log variant, unregistered_reads array<string>, inputs_not_in_pin variant, refused_late_inputs variant, host string, pid bigint
""".replace("\n", " ")
#: Where sidecars nest what histories have flat: normalised name -> paths in order.
SIDECAR = (
    "code struct<imported:struct<count:bigint,digest:string,omitted:bigint>,git_commit:string>, "
    "environment struct<packages:map<string,string>,snapshot:struct<path:string,sha256:string,python:string,error:string,package_sets_unavailable:string,package_sets:map<string,string>,n_packages:bigint,n_unreadable:bigint,n_conda_packages:bigint,reused:boolean,lockfiles:array<struct<name:string,sha256:string,bytes:bigint,path:string,archived:boolean,error:string>>>>"
)
