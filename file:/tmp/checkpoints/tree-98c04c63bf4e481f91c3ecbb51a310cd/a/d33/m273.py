x273