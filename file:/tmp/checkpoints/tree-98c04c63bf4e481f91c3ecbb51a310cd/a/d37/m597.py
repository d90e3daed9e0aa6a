x597