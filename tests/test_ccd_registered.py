from types import SimpleNamespace

from wordfold.plans import catalog_train


def test_registered_train_ccd_takes_the_defaults(spark, sf, monkeypatch):
    asked = []

    def noted(coo, p, growing=False):
        asked.append((p.k, p.iters, p.inner, p.eps, growing))
        return SimpleNamespace(w=None, h=None, history=[{"active": 10, "last": 0}], mean=0.0)

    monkeypatch.setattr(catalog_train, "train_ccd", noted)
    monkeypatch.setattr(catalog_train, "_beats_zero", lambda coo, res: True)
    monkeypatch.setattr(catalog_train, "rank_settled", lambda *a: None)
    monkeypatch.setattr(catalog_train, "cut_lineage", lambda df, name: df)
    catalog_train.QUERIES["train_ccd"](spark, sf)
    catalog_train.QUERIES["train_ccd_growing"](spark, sf)
    assert asked == [(10, 5, 5, 1e-3, False), (10, 5, 5, 1e-3, True)]
