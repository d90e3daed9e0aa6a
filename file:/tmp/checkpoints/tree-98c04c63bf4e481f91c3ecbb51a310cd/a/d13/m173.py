x173