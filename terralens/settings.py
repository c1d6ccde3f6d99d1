"""Defaults of the engine's parameters; every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # local features
    sift_features: int = 2000
    sift_contrast: float = 0.04
    sift_edge: float = 10.0
    sift_sigma: float = 1.6
    # preprocessing
    resize_scale: float = 1.0
    query_resize_scale: float | None = None
    patch_resize_scale: float | None = None
    #: meters a pixel of a query's photo; with it queries are sized to the ground distance of patches
    query_gsd_m: float | None = None
    normalize: bool = False
    clahe: bool = False
    lcn: bool = False
    # coarse vectors
    coarse_method: str = "vlad"
    bovw_words: int = 1024
    bovw_sample: int = 50
    bovw_restarts: int = 10
    vlad_centroids: int = 64
    vlad_sample: int = 100
    vlad_restarts: int = 3
    vlad_pca: bool = True
    vlad_pca_dim: int = 256
    token_pooling: str = "gem"
    token_gem_p: float = 3.0
    token_centroids: int = 32
    token_sample: int = 100
    token_restarts: int = 3
    # nearest-neighbour index
    n_lists: int = 256
    n_probe: int = 32
    flat_below: int = 50_000
    token_top_k: int = 300
    # tiling
    patch_size: int = 256
    overlap: float = 0.25
    min_coverage: float = 0.8
    gsd_m: float = 10.0
    # matching
    ransac_px: float = 5.0
    lowe_ratio: float = 0.75
    coarse_top_n: int = 100
    result_top_n: int = 10
    min_good_matches: int = 4
    mutual: bool = False
    photometric: bool = False
    photometric_min_overlap: float = 0.3
    exhaustive: bool = False

    def query_scale(self) -> float:
        """Pixels of a query that stand for one of its photo: by ground distances if the photo's is known."""
        if self.query_gsd_m is not None:
            if self.query_gsd_m <= 0 or self.gsd_m <= 0:
                raise ValueError("ground sampling distances are positive")
            return self.query_gsd_m / self.gsd_m
        return self.resize_scale if self.query_resize_scale is None else self.query_resize_scale

    def patch_scale(self) -> float:
        return self.resize_scale if self.patch_resize_scale is None else self.patch_resize_scale

    def encoder_params(self) -> dict:
        """What the encoder of `coarse_method` takes."""
        return {
            "bovw": {"words": self.bovw_words, "sample": self.bovw_sample, "restarts": self.bovw_restarts},
            "vlad": {"n_centroids": self.vlad_centroids, "sample": self.vlad_sample, "restarts": self.vlad_restarts, "pca_dim": self.vlad_pca_dim if self.vlad_pca else None},
            "dino": {"pooling": self.token_pooling, "p": self.token_gem_p},
            "dino_vlad": {"n_centroids": self.token_centroids, "sample": self.token_sample, "restarts": self.token_restarts},
        }.get(self.coarse_method, {})
