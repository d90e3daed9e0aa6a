x519