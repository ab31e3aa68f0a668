"""The image operators as a registry over rows of images (width, height): the
geometry of their pre-steps. Scorers are added by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lecterna.functions.vector import bucket
from lecterna.operators.detections import letterbox
from lecterna.plans.registry import BITS, Operator, Registry

# Input sizes of the detectors, crops of faces, and batch sizes of the operators.
FRAME, FACE_CROP, ORIENTATION_CROP, CLASS_CROP = (960, 544), 112, 192, 224
BATCH = {"ACT": 16, "FACEDET": 16, "FACE_SCORE": 32, "FACEREC": 32, "FACEORI": 32, "CLASSTYPE": 1, "RAISEHANDCLS": 1, "OCR_REC": 16}


def registry() -> Registry:
    r = Registry()
    w, h = F.col("width").cast("double"), F.col("height").cast("double")

    def add(name: str, depends: tuple[str, ...], columns: dict[str, Column]) -> None:
        r.add(Operator(name, BITS[name], None, tuple(BITS[d] for d in depends), ("width", "height"), None, lambda: columns))

    add("ACT", (), {"act_scale": letterbox(w, h, *FRAME)})
    # faces are sought in the frame that the first operator made
    add("FACEDET", ("ACT",), {"face_scale": F.col("act_scale")})
    add("FACE_SCORE", ("FACEDET",), {"score_side": F.lit(FACE_CROP)})
    add("FACEREC", ("FACEDET",), {"rec_side": F.lit(FACE_CROP)})
    add("FACEORI", ("FACEDET",), {"ori_side": F.lit(ORIENTATION_CROP)})
    add("RAISEHANDCLS", ("ACT",), {"hand_side": F.lit(CLASS_CROP)})
    add("CLASSTYPE", (), {"class_scale": F.lit(float(CLASS_CROP)) / F.least(w, h)})
    add("OCR_DET", (), {"ocr_scale": letterbox(w, h, *FRAME)})
    add("OCR_REC", ("OCR_DET",), {"ocr_width": bucket(F.ceil(w * 48 / h), [160, 320, 640, 1280, 2048]).cast("long")})
    return r
