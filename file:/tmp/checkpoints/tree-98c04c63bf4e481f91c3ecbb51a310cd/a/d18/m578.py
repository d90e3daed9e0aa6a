x578