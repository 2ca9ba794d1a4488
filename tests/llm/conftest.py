import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
sys.path[:0] = [ROOT, str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
