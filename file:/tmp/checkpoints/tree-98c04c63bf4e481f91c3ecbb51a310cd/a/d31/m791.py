x791