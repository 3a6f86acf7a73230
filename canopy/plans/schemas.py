"""Row types of the corpus."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TYPED = _struct(names=T.ArrayType(_S), type_src=_S, variadic=_B)
FIELD = _struct(names=T.ArrayType(_S), type_src=_S, type_end=_I, tag_src=_S, tag_start=_I, tag_end=_I)
MEMBER = _struct(method=_S, type_src=_S, params=T.ArrayType(TYPED), results=T.ArrayType(TYPED))
DECL = _struct(
    ord=_I, kind=_S, name=_S, receiver=_S, receiver_src=_S, receiver_var=_S, exported=_B, type_kind=_S, group_size=_I, doc=_S, spec_doc=_S,
    doc_start=_I, node_start=_I, node_end=_I, sym_start=_I, sym_end=_I, name_start=_I, line_start=_I, line_end=_I, body_start=_I, type_src=_S,
    signature_src=_S, fields=T.ArrayType(FIELD), members=T.ArrayType(MEMBER), params=T.ArrayType(TYPED), results=T.ArrayType(TYPED),
)
IMPORT = _struct(ord=_I, import_path=_S, alias=_S)
FILES = _struct(repo=_S, path=_S, content=T.BinaryType())
PARSED = _struct(
    repo=_S, path=_S, content=T.BinaryType(), package=_S, package_doc=_S, clause_ok=_B, imports_ok=_B, parse_ok=_B, parse_error=_S,
    imports=T.ArrayType(IMPORT), decls=T.ArrayType(DECL),
)
GRAPH_FILE = _struct(path=_S, symbols=T.ArrayType(_S))
PARAM = _struct(name=_S, type=_S, variadic=_B)
CATALOG = _struct(package=_S, iface=_S, ord=_I, method=_S, params=T.ArrayType(PARAM), results=T.ArrayType(PARAM))
ACTIONS = _struct(
    repo=_S, seq=_I, action=_S, file=_S, package=_S, identifier=_S, content=_S, mock_file=_S, mock_name=_S, doc=_S, strip_doc=_B
)
EDITED = _struct(repo=_S, path=_S, content=T.BinaryType())
OUTCOME = _struct(repo=_S, files_modified=_I, warnings=T.ArrayType(_S), messages=T.ArrayType(_S), failed_seq=_I, error_code=_S, error_message=_S)
MODULES = _struct(module_path=_S, version=_S, dir=_S, repo=_S)
