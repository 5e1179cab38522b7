"""Dimension values.  Fixed values: names, codes and their order are part of the data format."""

# fixed values
SUBTASKS = {
    "1.1": "scene_description",
    "1.2": "scene_comparison",
    "1.3": "observing_posture",
    "2.1": "object_recognition",
    "2.2": "object_counting",
    "2.3": "object_grounding",
    "2.4": "object_matching",
    "3.1": "quality_assessment",
    "3.2": "usability_assessment",
    "3.3": "causal_assessment",
    "4.1": "when_to_collaborate",
    "4.2": "what_to_collaborate",
    "4.3": "who_to_collaborate",
    "4.4": "why_to_collaborate",
}
# fixed values
DISTORTIONS = {
    "propeller_vibration_blur": "uav",
    "atmospheric_scattering_haze": "uav",
    "six_dof_viewpoint_blur": "uav",
    "communication_packet_loss": "uav",
    "low_res_super_resolution": "uav",
    "propeller_shadow": "uav",
    "gaussian_blur": "blur",
    "lens_blur": "blur",
    "motion_blur": "blur",
    "brighten_max": "brightness",
    "brighten_avg": "brightness",
    "darken_max": "brightness",
    "darken_min": "brightness",
    "darken_avg": "brightness",
    "color_diffusion": "chromatic",
    "color_shift": "chromatic",
    "color_quantize": "chromatic",
    "white_noise": "noise",
    "color_noise": "noise",
    "impulse_noise": "noise",
    "multiplicative_noise": "noise",
    "gaussian_denoise": "noise",
    "cnn_denoise": "noise",
    "jpeg_compression": "compression",
    "jp2k_compression": "compression",
    "webp_compression": "compression",
    "spatial_warp": "spatial",
    "spatial_scale": "spatial",
    "clock_jittering": "spatial",
    "resolution_limit": "other",
    "grayscale": "other",
    "sharpness": "other",
    "contrast": "other",
    "block_lost": "transmission",
    "block_interpolation": "transmission",
    "block_exchange": "transmission",
}
UAV_DISTORTIONS = [name for name, category in DISTORTIONS.items() if category == "uav"]
# fixed values
LEVELS = [2, 4, 6, 8, 10]
INTENSITIES = [0.2, 0.4, 0.6, 0.8, 1.0]
DATASETS = ["Sim3", "Sim5", "Sim6", "Real2"]
# fixed values: report categories
REPORT_CATEGORY = {"uav": "UAV", "blur": "Blur", "noise": "Noise", "brightness": "Luminance", "chromatic": "Chrominance", "compression": "Compression", "spatial": "Spatial", "transmission": "Other", "other": "Other"}
# fixed values: task groups of the report
TASK_GROUPS = {
    "Scene Understanding": ["Scene Description", "Scene Comparison", "Observing Posture"],
    "Object Understanding": ["Object Recognition", "Object Grounding", "Object Matching", "Object Counting"],
    "Perception Assessment": ["Quality Assessment", "Usability Assessment", "Causal Assessment"],
    "Collaboration": ["Who to Collaborate", "What to Collaborate", "Why to Collaborate", "When to Collaborate"],
}
# fixed values: printable vocabulary of the character tokenizer, after padding 0 and unknown 1
PRINTABLE = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?\"'()-[]{}@#$%^&*+=/\\<>_`~|"
# fixed values: score weights of BLEU, ROUGE-L and CIDEr
WEIGHTS = (1.0, 1.0, 0.1)
