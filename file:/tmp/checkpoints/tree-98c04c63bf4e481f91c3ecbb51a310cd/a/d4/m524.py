x524