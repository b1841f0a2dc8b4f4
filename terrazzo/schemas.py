"""Fixed schemas of the relations and artefacts; readers validate against them and infer nothing."""

from __future__ import annotations

from pyspark.sql import types as T

L, D, I, S, B = T.LongType(), T.DoubleType(), T.IntegerType(), T.StringType(), T.BinaryType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


FRAME = _of(scene=S, frame=L, color_path=S, depth_path=S, pose_path=S)
INTRINSICS = _of(scene=S, width=I, height=I, fx=D, fy=D, cx=D, cy=D)
POSE = _of(scene=S, frame=L, pose=T.ArrayType(D))
PIXEL = _of(scene=S, frame=L, u=I, v=I, depth=D)
SURFACE_POINT = _of(point_id=L, x=D, y=D, z=D, nx=D, ny=D, nz=D)
POINT_EDGE = _of(lo=L, hi=L, dist=D)
ATOM_MEMBER = _of(point_id=L, atom=L)
ATOM_EDGE = _of(a=L, b=L, cross_edges=L)
LEAF_I = _of(atom=L, frame=L, mask=L, cnt=L)
LEAF_N = _of(atom=L, frame=L, cnt=L)
TREE_NODE = _of(node=L, parent=L, left=L, right=L, lo=L, hi=L, size=L)
MEMBERSHIP = _of(hyp_id=L, point_id=L)
TSDF_VOXEL = _of(gx=L, gy=L, gz=L, tsdf=D, weight=D, r=D, g=D, b=D)
METRIC = _of(scene=S, name=S, value=D)

#: Format tags (fixed values after the writer's own name) and JSON layouts of a scene's files.
SCENE_FORMAT = r"^\w+_rgbd_v1$"
INTRINSICS_FORMAT = r"^\w+_pinhole_intrinsics_v1$"
SCENE_JSON = _of(format=S, name=S, width=I, height=I, fps=D, frames=T.ArrayType(T.MapType(S, S)), source=T.MapType(S, S))
INTRINSICS_JSON = _of(format=S, camera_model=S, width=I, height=I, fx=D, fy=D, cx=D, cy=D)
SEGMENTS_JSON = _of(segIndices=T.ArrayType(L))
AGGREGATION_JSON = _of(segGroups=T.ArrayType(_of(objectId=L, segments=T.ArrayType(L), label=S)))
