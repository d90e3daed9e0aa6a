x797