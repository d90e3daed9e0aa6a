x960