x288