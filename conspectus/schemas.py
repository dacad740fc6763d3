"""Schemas of the domain layer."""

IMPORTS = "array<struct<module:string,names:array<string>,is_type_only:boolean,line:int>>"
EXPORTS = "array<struct<name:string,is_default:boolean,is_type_only:boolean,line:int,end_line:int>>"
FUNCTIONS = "array<struct<name:string,is_public:boolean,is_async:boolean,line:int,end_line:int,parameters:array<string>,doc_comment:string>>"
TYPES = "array<struct<name:string,kind:string,is_public:boolean,line:int,end_line:int,doc_comment:string>>"
DEPENDENCIES = "array<struct<package:string,import_path:string,line:int>>"
CALLS = "array<struct<callee:string,line:int,end_line:int,snippet:string>>"

#: One row per source file; the variants of a language are nullable structs.
FILE = f"""branch_id string, path string, language string, content_hash string, file_doc string, imports {IMPORTS}, exports {EXPORTS}, functions {FUNCTIONS}, types {TYPES},
dependencies_used {DEPENDENCIES}, function_calls {CALLS},
rust struct<mod_declarations:array<struct<name:string,line:int>>,derive_macros:array<struct<type_name:string,derives:array<string>,line:int>>,trait_implementations:array<struct<trait_name:string,type_name:string,line:int>>,macro_calls:array<struct<name:string,line:int>>>,
typescript struct<has_barrel_exports:boolean,type_only_imports:array<string>,decorators:array<string>,default_export:boolean>,
javascript struct<module_system:string,has_module_exports:boolean,require_calls:array<string>>,
python struct<has_all_export:boolean,is_init_file:boolean,type_hints_used:boolean,decorators:array<string>>"""

FINDING = "path string, detector string, nature string, kind string, description string, follows boolean, line int, anchor string"

DECISION = "description_hash string, description string, state string, nature string, weight string, category string, reason string, decided_on_branch string, decided_at bigint, updated_at bigint"
