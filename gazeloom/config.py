"""Constants, tables and formats that decide the results."""

# Recording geometry and clocks.
WORLD_W, WORLD_H = 1280.0, 720.0
CONFIDENCE_THRESHOLD = 0.6
BLINK_MARGIN_S = 0.05
SMOOTH_WINDOW = 4
SMOOTH_JUMP_PX = 15.0

# Lens model of the scene camera: fx, fy, cx, cy and k1, k2, p1, p2, k3.
CAMERA = {
    "fx": 772.7579398984512, "fy": 774.7626776273447,
    "cx": 631.4741011592728, "cy": 356.73289033085894,
    "k1": -0.4505056528115055, "k2": 0.2805950523519397,
    "p1": -0.006409007397412659, "p2": -0.001745893974580009,
    "k3": -0.12523763341183008,
}

# Board: 8 columns x 5 rows, 312 x 195 mm, painted cells as fractions of the warped view.
BOARD_COLS, BOARD_ROWS = 8, 5
BOARD_MM = (312.0, 195.0)
GRID_FRAC = (0.027, 0.038, 0.974, 0.960)
CANVAS_FRAC = (0.0348, 0.0540, 0.9645, 0.9449)
COLORS = ("red", "green", "blue", "yellow")
SHAPES = ("circle", "square", "triangle", "hexagon", "trapezoid")

# Cells in row-major order: colour, shape, and whether the cell carries a piece.
LAYOUT = (
    (("yellow", "square", False), ("green", "hexagon", False), ("yellow", "circle", True), ("blue", "trapezoid", True), ("green", "triangle", False), ("red", "hexagon", True), ("blue", "square", True), ("red", "circle", False)),
    (("green", "circle", True), ("blue", "hexagon", True), ("red", "triangle", False), ("yellow", "hexagon", True), ("red", "square", True), ("yellow", "circle", False), ("green", "trapezoid", False), ("yellow", "triangle", False)),
    (("red", "trapezoid", True), ("yellow", "triangle", True), ("green", "square", True), ("blue", "hexagon", False), ("green", "triangle", True), ("blue", "trapezoid", True), ("red", "hexagon", False), ("blue", "square", True)),
    (("yellow", "hexagon", False), ("green", "square", False), ("blue", "circle", True), ("red", "square", True), ("yellow", "trapezoid", False), ("green", "hexagon", True), ("yellow", "square", True), ("green", "trapezoid", True)),
    (("blue", "triangle", True), ("red", "circle", True), ("yellow", "trapezoid", True), ("green", "circle", False), ("blue", "triangle", False), ("red", "trapezoid", True), ("blue", "circle", False), ("red", "triangle", True)),
)

# Default presentation order: one line per block, ten trials each.
PLAN = (
    ("yellow_circle", "red_hexagon", "green_triangle", "blue_circle", "red_triangle", "yellow_hexagon", "blue_triangle", "green_hexagon", "yellow_triangle", "red_circle"),
    ("red_hexagon", "yellow_triangle", "blue_circle", "green_triangle", "yellow_circle", "blue_triangle", "red_circle", "yellow_hexagon", "red_triangle", "green_hexagon"),
    ("red_circle", "yellow_triangle", "green_hexagon", "blue_triangle", "yellow_hexagon", "red_triangle", "blue_circle", "green_triangle", "red_hexagon", "yellow_circle"),
    ("yellow_hexagon", "red_triangle", "yellow_circle", "blue_triangle", "red_hexagon", "green_triangle", "blue_circle", "green_hexagon", "yellow_triangle", "red_circle"),
    ("red_circle", "blue_triangle", "yellow_circle", "green_triangle", "red_hexagon", "yellow_triangle", "blue_circle", "green_hexagon", "red_triangle", "yellow_hexagon"),
    ("green_hexagon", "red_triangle", "yellow_hexagon", "red_circle", "blue_triangle", "yellow_circle", "green_triangle", "blue_circle", "yellow_triangle", "red_hexagon"),
)

# Board markers: identifiers, upper-left corner on the sheet in cm, side length.
MARKERS = {
    510: (0.25, 29.75), 544: (0.25, 15.0), 561: (0.25, 0.25), 748: (15.05, 0.25), 714: (28.85, 0.25),
    612: (43.55, 0.25), 646: (43.55, 15.0), 663: (43.55, 29.75), 680: (28.85, 29.75), 578: (15.05, 29.75),
}
MARKER_SIDE_CM = 4.0

# Trial segmentation.
PANEL_CONFIRM = 4
CONTOUR_CONFIRM = 6
CONTOUR_LOSS = 4
CONTOUR_INERTIA = 2
TOUCH_THRESHOLD = {"red": 0.13, "yellow": 0.15, "blue": 0.20, "green": 0.20}
TOUCH_THRESHOLD_DEFAULT = 0.20
TOUCH_SEPARATION = 0.10
TOUCH_CONFIRM = 2
TOUCH_WARMUP = 3
RECOVERY_MAX = 75
RECOVERY_CONFIRM = 3
RECOVERY_MISSES = 2
FT_ENTER, FT_EXIT, FT_CONFIRM = 0.20, 0.05, 3
BOARD_ENTER, BOARD_EXIT, BOARD_CONFIRM = 0.12, 0.05, 3

# Landmarks and outcome.
EXIT_RATIO = 0.30
ONSET_GAP = 15
FOCAL_MIN_OCC = 0.15
FOCAL_MIN_SCORE = 1.0
FIXATION_DISPERSION = 0.06
FIXATION_MIN = 6
TARGET_MASS = 0.34
ERROR_PREFIXES = ("missing_trial_error", "transition_error", "end_of_video_error")
EARLY_TAGS = ("pre_start", "on_panel", "blank", "not_board")

# Calibration.
ASSIGN_RADIUS_PX = 70.0
PANEL_FIX_PX, PANEL_FIX_GAP_S, PANEL_FIX_MIN = 20.0, 0.25, 15
GATE_MIN_BASE_PX = 12.0
BOOTSTRAP_REPS = 500
CONF_BINS = ((0.6, 0.75), (0.75, 0.85), (0.85, 0.93), (0.93, 0.98), (0.98, 1.01))
BIN_MIN_SAMPLES = 30


def layout_rows():
    """(col, row, color, shape, is_piece) for the 40 cells."""
    return [(col, row, *cell) for row, cells in enumerate(LAYOUT) for col, cell in enumerate(cells)]


def plan_rows():
    """(block, pos, trial, name) for the default plan."""
    return [(block, pos, pos, name) for block, names in enumerate(PLAN) for pos, name in enumerate(names)]
