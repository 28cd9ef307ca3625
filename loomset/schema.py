"""Domains, field aliases and types of the curated samples."""

from __future__ import annotations

# Literals that are stored in the data. The order is the sort order.
STATUSES = ("推荐", "备选", "淘汰")
PICKED, BACKUP, REJECTED = STATUSES
SCALES = ("近景/头肩", "半身", "大半身", "全身")
YAWS = ("正脸", "左3/4", "右3/4", "左侧脸", "右侧脸")
PITCHES = ("正常", "仰头", "低头")
ELIGIBILITIES = ("PASS", "REVIEW", "REJECT")
SCALE_WEIGHTS = {"近景/头肩": 0.35, "半身": 0.30, "大半身": 0.20, "全身": 0.15}
YAW_WEIGHTS = {"正脸": 0.35, "左3/4": 0.20, "右3/4": 0.20, "左侧脸": 0.125, "右侧脸": 0.125}
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")
READABLE_VERSIONS, CACHE_VERSION, ANALYSIS_VERSION = (1, 2, 3), 3, 4
COMPOSITE_VERSION, CROP_VERSION, CROP_READABLE = 2, 2, (1, 2)
IGNORED_GROUP = -1
DEFAULT_TARGET, TARGET_PRESETS = 60, (40, 50, 60, 70, 80)

FINDING = "struct<code:string,source:string,value:double,threshold:double,detail:string>"
#: Fields by which views filter.
FIELDS = ("status", "person_scale", "angle_class", "pitch_class", "eligibility", "duplicate_group", "source", "face_quality", "brisque", "blur", "face_px")

# What findings say, by code; %d is the number of faces.
FINDING_TEXTS = {
    "no_face_full_body_review": "未检测到人脸，但检测到全身；可能是有价值的背身/背面素材，需人工确认",
    "secondary_faces_detected": "去重后仍检测到 %d 张独立人脸，需确认是否多人",
    "low_resolution": "图片短边分辨率低于 512px",
    "low_face_pixels": "主脸实际像素偏小",
    "low_face_ratio": "主脸占画面比例偏低",
    "severe_face_blur": "主脸明显模糊",
    "low_face_quality": "eDifFIQA 人脸质量偏低",
    "high_brisque": "BRISQUE 整图质量偏低",
    "extreme_exposure": "图像疑似严重欠曝或过曝",
    "no_face_not_full_body": "两个检测阈值均未找到人脸，且不是全身图",
    "read_error": "无法读取图片：",
}

# What is said about a recommendation; %s and numbers are filled in.
REASON_TEXTS = {
    "chosen": "自动推荐：通过基础门槛，并用于补足 %s / %s 覆盖",
    "copy": "Duplicate Group %d 已保留更优代表（组内 %d/%d）",
    "not_chosen": "已通过基础门槛，但当前自动目标 %d 张的景别×角度覆盖分配未选中（%s / %s）",
    "manual": "人工状态优先：%s（自动基线：%s）",
    "rejected": "硬淘汰：",
    "review": "需先复核：",
    "noise": "BRISQUE %.1f > 70",
    "blur": "主脸清晰度 %.1f < 40",
}
