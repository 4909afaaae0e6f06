"""Data sources that Spark lacks: directory trees as rows, and YAML documents."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

try:
    import yaml
except ImportError:  # the yaml source then says so when it is used
    yaml = None


class _Subtree(InputPartition):
    def __init__(self, path: str, whole: bool):
        self.path, self.whole = path, whole


class _Local:
    """Folders of a file system that all executors mount."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def names(self, path: str) -> list[str]:
        return sorted(os.listdir(os.path.join(self.root, path)))

    def entry(self, path: str) -> tuple[str, int | None]:
        full = os.path.join(self.root, path)
        if os.path.islink(full):  # a link is a link, whatever it points to
            return "link", None
        return ("dir", None) if os.path.isdir(full) else ("file", os.path.getsize(full))


class _Remote:
    """Folders by their address (hdfs, s3, gs, file): what pyarrow reads. It tells no links."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, at = fs.FileSystem.from_uri(root)
        self.root = at.rstrip("/")

    def names(self, path: str) -> list[str]:
        from pyarrow import fs

        return sorted(x.base_name for x in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{path}".rstrip("/"))))

    def entry(self, path: str) -> tuple[str, int | None]:
        from pyarrow import fs

        x = self.fs.get_file_info(f"{self.root}/{path}")
        return ("dir", None) if x.type == fs.FileType.Directory else ("file", x.size)


class _TreeReader(DataSourceReader):
    #: Folders are opened level by level until there are so many parts to be read side by side.
    PARTS = 64

    def __init__(self, root: str):
        self.root = root

    def _open(self) -> _Local | _Remote:
        return _Remote(self.root) if "://" in self.root else _Local(self.root)

    def partitions(self) -> list[InputPartition]:
        """Subtrees, and the single folders above them."""
        tree = self._open()
        above: list[InputPartition] = []
        level = tree.names("")
        for _ in range(8):
            folders = [x for x in level if tree.entry(x)[0] == "dir"]
            if len(level) >= self.PARTS or not folders:
                break
            above += [_Subtree(x, False) for x in folders]
            level = [x for x in level if x not in set(folders)] + [f"{x}/{n}" for x in folders for n in tree.names(x)]
        return above + [_Subtree(x, True) for x in level] or [_Subtree("", False)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        tree = self._open()
        todo = [partition.path] if partition.path else []
        while todo:
            at = todo.pop()
            kind, size = tree.entry(at)
            yield at, os.path.dirname(at), os.path.basename(at), kind, at.count("/"), size
            if kind == "dir" and partition.whole:
                todo += [f"{at}/{n}" for n in reversed(tree.names(at))]


class TreeSource(DataSource):
    """spark.read.format("tree").load(folder): path, parent, name, kind (dir, file, link), depth, size.

    The folder is a path that all executors see, or an address of a file system (hdfs://, s3://, file://). Links are
    not followed; an address knows no links.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, parent string, name string, kind string, depth int, size bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def hidden(name) -> F.Column:  # noqa: ANN001
    return F.startswith(name, F.lit("."))


def child_dirs(tree: DataFrame) -> DataFrame:
    """Directories that aren't hidden, in order of path."""
    return tree.where(F.col("kind") == "dir").where(~hidden(F.col("name"))).orderBy("path")


def nodes(tree: DataFrame, meta: str = "meta.yaml") -> DataFrame:
    """Directories that hold a metadata file."""
    has = tree.where(F.col("name") == meta).select(F.col("parent").alias("path")).distinct()
    return child_dirs(tree).join(has, "path", "left_semi")


def flatten(value: object, path: str = "") -> Iterator[tuple[str, str | None]]:
    """The leaves of a nested document as (path, text); list items are numbered from 0."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from flatten(v, f"{path}/{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from flatten(v, f"{path}/{k}" if path else str(k))
    elif isinstance(value, (dict, list)):
        return
    else:
        yield path, None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def yaml_leaves(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, path, value, error: the leaves of YAML texts. An empty or null text has none; a text that
    isn't YAML gives one row with an error and no path."""
    if yaml is None:
        raise RuntimeError("reading YAML needs PyYAML")
    from quire.runtime import ship

    ship(texts.sparkSession)

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["text"]):
                try:
                    rows += [(k, i, p, v, None) for i, (p, v) in enumerate(flatten(yaml.safe_load(t or "") or {}))]
                except yaml.YAMLError as e:
                    rows.append((k, 0, None, None, str(e).split("\n")[0]))
            yield pd.DataFrame(rows, columns=["key", "pos", "path", "value", "error"])

    kind = texts.schema[key].dataType.simpleString()
    d = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return d.mapInPandas(run, f"key {kind}, pos int, path string, value string, error string").withColumnRenamed("key", key)


def read_yaml(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """Leaves of all YAML files under a folder; the key is the file's path."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return yaml_leaves(whole.select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value")


def valid_utf8(files: DataFrame, content: str = "content") -> DataFrame:
    """Binary files with a flag whether they are UTF-8 throughout; null content is none."""
    return files.withColumn("utf8", F.coalesce(F.is_valid_utf8(F.col(content).cast("string")), F.lit(False)))


def node_metadata(nodes_: DataFrame, leaves: DataFrame, meta: str = "meta.yaml") -> DataFrame:
    """Nodes (path) with the leaves (file, path, value) of their metadata file as a map meta; a node whose file is empty
    has an empty map, one whose file couldn't be read a null."""
    of = leaves.where(F.endswith("file", F.lit("/" + meta))).select(F.regexp_replace("file", f"/{meta}$", "").alias("path"), F.col("path").alias("_k"), F.col("value").alias("_v"), "error")
    made = of.groupBy("path").agg(F.map_from_entries(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v")))).alias("meta"), F.max("error").alias("_e"))
    d = nodes_.join(made, "path", "left")
    return d.withColumn("meta", F.when(F.col("_e").isNull(), F.coalesce("meta", F.create_map().cast("map<string,string>")))).drop("_e")


def revision(folder: str) -> tuple[str | None, str | None]:
    """Hash (short) and branch of a git folder, from its files; nulls where there is none."""
    head = os.path.join(folder, ".git", "HEAD")
    if not os.path.isfile(head):
        return None, None
    with open(head) as f:
        at = f.read().strip()
    if not at.startswith("ref: "):
        return at[:7], None
    ref, branch = at[5:], at.rsplit("/", 1)[-1]
    loose, packed = os.path.join(folder, ".git", ref), os.path.join(folder, ".git", "packed-refs")
    if os.path.isfile(loose):
        with open(loose) as f:
            return f.read().strip()[:7], branch
    if os.path.isfile(packed):
        with open(packed) as f:
            return next((x.split()[0][:7] for x in f if x.strip().endswith(" " + ref)), None), branch
    return None, branch


def build_information(spark: SparkSession, user: str, tool: str, repo: str) -> DataFrame:
    """One row: who builds, the revisions of the tool's and the texts' folders, and the time."""
    pairs = [F.struct(F.lit(h).cast("string").alias("hash"), F.lit(b).cast("string").alias("branch")) for h, b in (revision(tool), revision(repo))]
    return spark.range(1).select(F.lit(user).alias("user"), pairs[0].alias("tool"), pairs[1].alias("repo"), F.current_timestamp().alias("timestamp"))
