"""Set-at-a-time operators on the node table and the page table."""
