x701