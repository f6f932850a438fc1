"""The engine's facade: one object over a catalogue.

Reads return DataFrames; changes return a new facade over the next state, so a
chain of changes is one plan until something reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog import Catalog
from lumenframe.functions import text as T
from lumenframe.operators import media as M
from lumenframe.operators import mutations as X
from lumenframe.operators import people as P


@dataclass(frozen=True)
class Database:
    catalog: Catalog

    def _next(self, change, *args, **options) -> Database:
        return Database(change(self.catalog, *args, **options))

    # media
    def get_media(self, path: str) -> DataFrame:
        return M.media_by_path(self.catalog, path)

    def get_media_paged(self, **filters) -> DataFrame:
        return M.media_page(self.catalog, **filters)

    def get_all_media_paths(self) -> DataFrame:
        return self.catalog.media.select("file_path")

    def get_media_paths_in_folder(self, folder: str) -> DataFrame:
        return self.catalog.media.where(T.under_folder(F.col("path_key"), folder)).select("file_path")

    def get_years(self, cluster_id: int | None = None, include_trash: bool = False) -> DataFrame:
        return M.years_facet(self.catalog, cluster_id, include_trash)

    def get_months(self, cluster_id: int | None, year: int, include_trash: bool = False) -> DataFrame:
        return M.months_facet(self.catalog, cluster_id, year, include_trash)

    def get_locations(self, cluster_id: int | None = None, year: int | None = None, month: int | None = None, include_trash: bool = False) -> DataFrame:
        return M.locations_facet(self.catalog, cluster_id, year, month, include_trash)

    def get_root_category_counts(self, root: str | None = None) -> DataFrame:
        return M.root_counts(self.catalog, root)

    def get_duplicate_stats(self, **filters) -> DataFrame:
        return M.duplicate_stats(self.catalog, **filters)

    def get_duplicate_groups(self) -> DataFrame:
        return M.duplicate_members(self.catalog)

    def get_salient_feature(self, path: str) -> DataFrame:
        return self.catalog.features.where(F.col("file_path") == path)

    def add_media_batch(self, batch: DataFrame) -> Database:
        return self._next(X.upsert_media, batch)

    def update_salient_features_batch(self, batch: DataFrame) -> Database:
        return self._next(X.upsert_features, batch)

    def delete_media(self, path: str) -> Database:
        return self._next(X.delete_media, [path])

    def delete_media_batch(self, paths: list[str]) -> Database:
        return self._next(X.delete_media, paths)

    def merge_duplicate_paths_batch(self, mapping: DataFrame) -> Database:
        return self._next(X.merge_paths, mapping)

    def release_files_from_groups(self, paths: list[str]) -> Database:
        return self._next(X.release_from_groups, paths)

    def clear_ai_duplicate_groups(self, folder: str | None = None) -> Database:
        return self._next(X.clear_ai_groups, folder)

    def unify_duplicate_hashes(self, members: DataFrame) -> Database:
        return self._next(X.persist_groups, members)

    # faces and persons
    def get_face_counts(self) -> DataFrame:
        return P.face_counts(self.catalog)

    def get_clusters(self, include_ignored: bool = False) -> DataFrame:
        return P.person_list(self.catalog, include_ignored)

    get_person_list = get_clusters

    def get_person_list_fast(self) -> DataFrame:
        return P.person_list_fast(self.catalog)

    def get_faces_by_category(self, category: str, person: int | None = None, **page) -> DataFrame:
        return P.faces_page(self.catalog, category, person, **page)

    def get_faces_by_ids(self, ids: list[int]) -> DataFrame:
        return P.faces_by_ids(self.catalog, ids)

    def get_faces_for_file(self, path: str) -> DataFrame:
        return self.catalog.faces.where(F.col("path_key") == path.lower())

    def get_ignored_faces(self) -> DataFrame:
        return self.catalog.faces.where("is_ignored = 1")

    def upsert_cluster(self, cluster_id: int, name: str) -> Database:
        return self._next(X.rename_cluster, cluster_id, name)

    def rename_person(self, label: str, name: str) -> Database:
        return self._next(X.rename_person, label, name)

    def create_cluster_manual(self, name: str) -> Database:
        return self._next(X.create_cluster, name)

    def create_clusters_batch(self, labels: DataFrame) -> Database:
        return self._next(X.ensure_clusters, labels)

    def add_faces_batch(self, faces: DataFrame) -> Database:
        return self._next(X.add_faces, faces)

    def update_faces_association_batch(self, ids: list[int], cluster_id: int | None, ignored: int = 0) -> Database:
        return self._next(X.assign_faces, ids, cluster_id, ignored)

    update_faces_cluster_batch = update_faces_association_batch

    def update_face_cluster(self, face_id: int, cluster_id: int) -> Database:
        return self._next(X.assign_faces, [face_id], cluster_id)

    def set_cluster_ignored(self, cluster_id: int, ignored: bool) -> Database:
        return self._next(X.set_cluster_ignored, cluster_id, int(ignored))

    def remove_face(self, face_id: int) -> Database:
        return self._next(X.remove_faces, [face_id])

    def remove_face_batch(self, ids: list[int]) -> Database:
        return self._next(X.remove_faces, ids)

    def delete_cluster(self, cluster_id: int) -> Database:
        return self._next(X.delete_cluster, cluster_id)

    def delete_empty_clusters(self) -> Database:
        return self._next(X.delete_empty_clusters)

    def clear_face_data(self, folder: str | None = None) -> Database:
        return self._next(X.clear_faces, folder)

    def clear_faces_for_file(self, path: str) -> Database:
        return self._next(X.clear_faces_for_file, path)

    def clear_all_data(self) -> Database:
        return self._next(X.clear_all)

    def sync_capture_dates(self) -> Database:
        return self._next(X.sync_capture_dates)

    # settings
    def get_setting(self, key: str, default: str | None = None) -> DataFrame:
        return P.setting_get(self.catalog.settings, key, default)

    def get_all_settings(self) -> DataFrame:
        return P.settings_map(self.catalog.settings)

    def save_setting(self, key: str, value: object) -> Database:
        return Database(self.catalog.having(settings=P.setting_put(self.catalog.settings, key, value)))
